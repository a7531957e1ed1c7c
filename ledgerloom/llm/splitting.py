"""Problem 8: splitting oversized items at natural boundaries.

Structure-tree packing. A text is read as a tree: sections under headings (marked, underlined, numbered, or tags), blocks
between blank lines (a fenced block is one), list items with the items nested in them, lines, sentences, words. Whole
sibling subtrees of one parent are merged as long as they stay within the limit; only a node beyond it is opened, and
its parts are never merged with its siblings. What no boundary divides (an unbroken run) is cut between tokens, never
inside a character.

Sizes are tokens. The tokenizer cuts a text into pieces before it merges, and all cuts but those in unbroken runs lie
between such pieces, so sizes add up but for the last pieces before a cut, which are encoded once more.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARIES, Encoder, encoder

_LINE = regex.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_HEADING = regex.compile(r"(#{1,6})\s+\S|(\d+(?:\.\d+)*)[.)]?\s+\S")
_UNDERLINE = regex.compile(r"(?:(={3,})|-{3,})\s*")
_TAG = regex.compile(r"(?i)<(?:h([1-6])|(p|div|section|article|table|ul|ol|pre|blockquote|hr)|(li|tr|dt|dd|br))\b")
_ITEM = regex.compile(r"([ \t]*)(?:[-*+•–]|\d{1,4}[.)])[ \t]+\S")
_FENCE = regex.compile(r"\s*(?:```|~~~)")
_SENTENCE = regex.compile(r"(?<=[.!?;…][\"')\]]*)\s+|(?<=[。！？।॥])")

#: Depth of a node's level; sections use the depth of their heading, 1 to 6, list items 20 and on by their nesting.
BLOCK, ITEM, LINE, SENTENCE, WORD = 10, 20, 29, 30, 40
#: Characters that a numbered line has at most to be a heading.
HEADING_LENGTH = 80


def _heading(body: str, blank: bool, following: str | None) -> int | None:
    """The depth of a heading, None for another line. ``blank``: a blank line or nothing is before it; ``following``: the next line."""
    found = _HEADING.match(body)
    if found and found.group(1):
        return len(found.group(1))
    tag = _TAG.match(body)
    if tag and tag.group(1):
        return int(tag.group(1))
    if body and following is not None and (under := _UNDERLINE.fullmatch(following)) and not _UNDERLINE.fullmatch(body) and not _ITEM.match(body):
        return 1 if under.group(1) else 2
    # "2.1 Fees" is a heading; "2. Fees" only where it stands alone, else it is an item of a list.
    if found and blank and len(body) <= HEADING_LENGTH and body[-1] not in ".;,:!?" and ("." in found.group(2) or not (following or "").strip()):
        return min(found.group(2).count(".") + 1, 6)
    return None


def boundaries(text: str) -> list[tuple[int, int]]:
    """(place, level) of every natural boundary inside the text, by place; a boundary of a lower level divides more."""
    found: dict[int, int] = {}
    lines = [m.span() for m in _LINE.finditer(text) if m.start() < m.end()]
    fenced, blank, underlined = False, True, False
    for k, (start, end) in enumerate(lines):
        line = text[start:end]
        body = line.strip()
        fence = bool(_FENCE.match(line))
        level = LINE
        if fenced or underlined:
            level = WORD if underlined else LINE  # an underline is its heading's
            underlined = False
        else:
            following = text[slice(*lines[k + 1])] if k + 1 < len(lines) else None
            depth = _heading(body, blank, following)
            item, tag = _ITEM.match(line), _TAG.match(body)
            if depth:
                level, underlined = depth, not body.startswith("#") and following is not None and bool(_UNDERLINE.fullmatch(following))
            elif item:
                level = ITEM + min(len(item.group(1).expandtabs(4)) // 2, LINE - ITEM - 1)
            elif (blank and body) or fence or (tag and tag.group(2)):
                level = BLOCK
            elif tag:
                level = ITEM
        blank = not body
        if start:
            found[start] = min(level, found.get(start, WORD))
        if fence:
            fenced = not fenced
        for gap in _SENTENCE.finditer(text, start, end):
            if start < gap.end() < end:
                found.setdefault(gap.end(), SENTENCE)
    return sorted((p, level) for p, level in found.items() if 0 < p < len(text) and level < WORD)


def measure(e: Encoder, text: str) -> tuple[list[int], list[int]]:
    """Starts, in characters, and sizes, in tokens, of the pieces that the tokenizer cuts a text into."""
    kept, piece = e.kept, e.piece
    words = e.cut.findall(text)
    return [0, *accumulate(map(len, words))][:-1], [len(kept.get(w) or piece(w)) for w in words]


class Splitter:
    """Cuts texts into pieces of at most ``max_tokens`` tokens, neighbours sharing ``overlap`` tokens."""

    def __init__(self, encode: Encoder, max_tokens: int, overlap: int):
        if not 0 <= overlap < max_tokens:
            raise ValueError("the overlap must be smaller than the limit")
        self.e, self.max, self.overlap = encode, max_tokens, overlap
        self.room = max_tokens - overlap  # for what a piece adds to its forerunner
        self.longest = max(map(len, encode.ranks))  # characters of a token at most

    def split(self, text: str | None, measured: tuple[list[int], list[int]] | None = None) -> list[tuple[int, int, int, int]]:
        """(start, end, n_tokens, shared) of the pieces of a text beyond the limit, in characters; none for a text within it.

        ``shared`` is how many characters at its start a piece shares with the one before. ``measured``: what ``measure`` gives
        for the text, if it is known already.
        """
        if not text:
            return []
        measured = measured or measure(self.e, text)
        if sum(measured[1]) <= self.max:
            return []
        starts, sizes = self._words(text, *measured)
        self.whole = len(starts) == len(measured[0])  # no run was cut
        self.starts, self.sums = starts, [0, *accumulate(sizes)]
        cuts = self._snap(boundaries(text), starts)
        cores = self._pack(0, len(starts), cuts, 0, len(cuts))
        ends = [*starts, len(text)]
        return self._finish(text, [(ends[a], ends[b]) for a, b in cores])

    def _words(self, text: str, at: list[int], sizes: list[int]) -> tuple[list[int], list[int]]:
        """Starts and sizes of the tokenizer's pieces; those beyond the room are cut between tokens."""
        if max(sizes) <= self.room:
            return at, sizes
        starts, out = [], []
        for start, end, size in zip(at, [*at[1:], len(text)], sizes):
            for part in [text[start:end]] if size <= self.room else self._run(text[start:end]):
                starts.append(start)
                out.append(size if size <= self.room else self.e.count(part))
                start += len(part)
        return starts, out

    def _run(self, run: str) -> list[str]:
        """An unbroken run in parts of at most ``room`` tokens."""
        data, out, at = run.encode(), [], 0
        ends = list(accumulate(len(token) for token in self.e.merge(data)))
        while at < len(data):
            k = bisect_right(ends, at) + self.room
            end = ends[min(k, len(ends)) - 1]
            while True:
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end -= 1  # inside a character
                part = data[at:end].decode() if end > at else ""
                if part and self.e.count(part) <= self.room:
                    break
                if len(part) <= 1:  # a single character beyond the room can't be cut
                    part = part or data[at:].decode()[0]
                    break
                end = at + len(part[: max(1, len(part) * 7 // 8)].encode())
            out.append(part)
            at += len(part.encode())
        return out

    @staticmethod
    def _snap(found: list[tuple[int, int]], starts: list[int]) -> list[tuple[int, int]]:
        """Boundaries as (number of the word they stand before, level); one inside a word moves to the word's start."""
        by_word: dict[int, int] = {}
        for place, level in found:
            w = bisect_right(starts, place) - 1
            if w > 0:
                by_word[w] = min(level, by_word.get(w, WORD))
        return sorted(by_word.items())

    def _pack(self, a: int, b: int, cuts: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
        """Words a to b as runs within the room: a node's children, neighbours merged whole, those beyond the room opened. cuts[lo:hi] are the boundaries strictly inside."""
        if self.sums[b] - self.sums[a] <= self.room:
            return [(a, b)]
        if lo == hi:
            children = [(w, w + 1, 0, 0) for w in range(a, b)]
        else:
            top = min(level for _, level in cuts[lo:hi])
            at = [k for k in range(lo, hi) if cuts[k][1] == top]
            starts, ends = [a, *(cuts[k][0] for k in at)], [*(cuts[k][0] for k in at), b]
            children = list(zip(starts, ends, [lo, *(k + 1 for k in at)], [*at, hi]))
        out: list[tuple[int, int]] = []
        joinable = False  # the last run is made of whole children
        for x, y, first, last in children:
            if self.sums[y] - self.sums[x] > self.room and y - x > 1:
                out += self._pack(x, y, cuts, first, last)
                joinable = False
            elif joinable and self.sums[y] - self.sums[out[-1][0]] <= self.room:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
                joinable = True
        return out

    def _size(self, text: str, start: int, end: int) -> int:
        """Tokens of a stretch: the sizes of its pieces where it starts with one; only the last two, that the end may change, are encoded."""
        a, b = bisect_left(self.starts, start), bisect_left(self.starts, end)
        if self.whole and b - a > 2 and self.starts[a] == start:
            return self.sums[b - 2] - self.sums[a] + self.e.count(text[self.starts[b - 2] : end])
        return self.e.count(text[start:end])

    def _back(self, text: str, lowest: int, end: int, tokens: int) -> int:
        """Where the ``tokens`` tokens before ``end`` start, or the most below that which can be cut off cleanly."""
        w = bisect_left(self.starts, end)
        first = max(bisect_left(self.sums, self.sums[w] - tokens), 0)
        start = max(self.starts[first] if first < w else end, lowest)
        missing = tokens - (self.sums[w] - self.sums[first])
        if missing > 0 and first > 0 and self.starts[first - 1] >= lowest:  # some tokens of the word before
            word = text[self.starts[first - 1] : start]
            guess = len(b"".join(self.e.merge(word.encode())[-missing:]).decode(errors="ignore"))
            # No token is longer than the longest, so a suffix of ``missing`` tokens isn't longer than so many of these.
            most, best = min(len(word) - 1, missing * self.longest), (0, 0)
            for size in sorted(range(1, most + 1), key=lambda k: abs(k - guess)):
                n = self.e.count(word[-size:])
                if n == missing:
                    return start - size
                if n < missing:
                    best = max(best, (n, size))
            return start - best[1]
        return start

    def _shared_starts(self, text: str, lowest: int, end: int) -> Iterator[int]:
        """Starts to share ``overlap`` tokens of the text before ``end``, best first; the last leaves the piece within the limit."""
        if self.overlap:
            tokens, first, best = self.overlap, None, None
            for _ in range(3):
                start = self._back(text, lowest, end, tokens)
                first = start if first is None else first
                shared = self._size(text, start, end)  # white space at the end of a text has fewer tokens
                if shared <= self.overlap:
                    best = max(best or (shared, start), (shared, start), key=lambda x: x[0])
                if shared >= self.overlap:
                    break
                tokens += self.overlap - shared
            if best:
                yield best[1]
            yield first
            w = bisect_left(self.starts, end)
            yield max(self.starts[min(bisect_left(self.sums, self.sums[w] - self.overlap), w - 1)], lowest)
        yield end

    def _finish(self, text: str, cores: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        out: list[tuple[int, int, int, int]] = []
        for a, b in cores:
            for start in self._shared_starts(text, out[-1][0], a) if out else [a]:
                n, shared = self._size(text, start, b), self._size(text, start, a)
                if n <= self.max and shared <= self.overlap:
                    break
            if n > self.max and b - a > 1:  # rare: a seam inside a run merged otherwise
                mid = (a + b) // 2
                out += self._finish(text, [(a, mid), (mid, b)])
            else:
                out.append((start, b, n, a - start))
        return out


def split_documents(documents: DataFrame, limits: list[tuple[str, str, int, int]], folder: str = VOCABULARIES) -> DataFrame:
    """(limit_name, doc_id, piece_no, start, end, n_tokens, shared_tokens, piece): the pieces of every document beyond a limit.

    ``limits``: (limit_name, tokenizer, max_tokens, overlap_tokens). Pieces are numbered from 0, ``start`` and ``end`` are
    characters of the text; the pieces without what they share are the text again. ``shared_tokens`` is the size of what
    a piece shares with the one before: the limit's overlap, or the most below it that can be cut off between tokens and
    characters. Null and empty texts and texts within a limit have no pieces; repeated rows are cut each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutters = [(name, Splitter(encoder(tokenizer, folder), most, overlap)) for name, tokenizer, most, overlap in limits]
        names = ["limit_name", "doc_id", "piece_no", "start", "end", "n_tokens", "shared_tokens", "piece"]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py()
                known: dict = {}
                for name, cutter in cutters:
                    if text and id(cutter.e) not in known:
                        known[id(cutter.e)] = measure(cutter.e, text)
                    for k, (a, b, n, shared) in enumerate(cutter.split(text, known.get(id(cutter.e)))):
                        rows.append((name, doc_id, k, a, b, n, cutter.e.count(text[a : a + shared]), text[a:b]))
                if len(rows) > 5_000:
                    yield _batch(rows, names, batch["doc_id"].type)
                    rows = []
            if rows:
                yield _batch(rows, names, batch["doc_id"].type)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"limit_name string, doc_id {kind}, piece_no int, start int, end int, n_tokens int, shared_tokens int, piece string"
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.string(), id_type, *[pa.int32()] * 5, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


def oversized(documents: DataFrame, limits: list[tuple[str, str, int, int]], limit: str, folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id): the documents that one limit cuts, by their first pieces."""
    return split_documents(documents, [x for x in limits if x[0] == limit], folder).where("piece_no = 0").select("doc_id").distinct()
