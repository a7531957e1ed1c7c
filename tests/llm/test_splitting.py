import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.bpe import encoder
from ledgerloom.llm.splitting import BLOCK, ITEM, LINE, SENTENCE, Splitter, boundaries, oversized, split_documents

E = encoder("byte_bpe_50k")


def check(text, most, overlap):
    pieces = Splitter(E, most, overlap).split(text)
    assert bool(pieces) == (E.count(text) > most)
    if pieces:
        assert "".join(text[a + shared : b] for a, b, _, shared in pieces) == text
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, n, shared in pieces:
        assert n == E.count(text[a:b]) <= most and E.count(text[a : a + shared]) <= overlap
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=600), st.sampled_from([(8, 0), (8, 3), (20, 5), (64, 16)]))
def test_any_text(text, limit):
    check(text.encode("utf-8", "ignore").decode(), *limit)


def test_runs_and_scripts():
    r = random.Random(3)
    for text in ("x" * 5_000, " " * 3_000, "\n" * 2_000, "é" * 2_000, "日本語" * 900, "".join(r.choice("abcdef0123") for _ in range(6_000)), "क्षेत्र " * 700):
        for limit in ((8, 3), (128, 16), (512, 64)):
            check(text, *limit)


def test_boundaries_are_a_tree():
    text = "# A\n\nOne. Two.\nthree\n\n## B\n- x\n- y\n```\n# no heading. here\n\ncode\n```\nend"
    found = {text[p : p + 5]: level for p, level in boundaries(text)}
    assert found["One. "] == BLOCK and found["Two.\n"] == SENTENCE and found["three"] == LINE and found["## B\n"] == 2 and found["- x\n-"[:5]] == ITEM
    assert found["# no "] == LINE and found["```\n#"[:5]] == BLOCK


def test_headings_and_nested_lists():
    text = "Intro\n=====\nText here\n\nPart\n---\n\n1 Fees\n\n1.1 Cards\n- a\n  - b\n  - c\n- d\nplain\n<h3>Tag</h3>\n<p>para\n<li>item\n\n2. an item, not a heading\n3. another"
    found = {text[p:].split("\n")[0]: level for p, level in boundaries(text)}
    assert "=====" not in found and "---" not in found
    assert (found["Part"], found["1 Fees"], found["1.1 Cards"], found["<h3>Tag</h3>"]) == (2, 1, 2, 3)
    assert (found["- a"], found["  - b"], found["  - c"], found["- d"]) == (ITEM, ITEM + 1, ITEM + 1, ITEM)
    assert (found["plain"], found["<p>para"], found["<li>item"], found["2. an item, not a heading"], found["3. another"]) == (LINE, BLOCK, ITEM, ITEM, ITEM)


def test_whole_siblings_only():
    # Each section is beyond the limit and leaves a small rest, which isn't merged with the next section.
    text = "\n\n".join(f"# Part {k}\n\n" + "\n\n".join("word " * 30 for _ in range(4)) for k in range(3))
    pieces = check(text, 100, 0)
    assert all(text[a:b].count("# Part") == (1 if text[a:b].startswith("# Part") else 0) for a, b, _, _ in pieces)
    # An item stays with the items nested in it where both fit.
    nested = "\n".join(f"- top {k}\n" + "\n".join(f"  - nested {k} {j}" for j in range(4)) for k in range(12))
    assert all(nested[a:b].startswith("- top") for a, b, _, _ in check(nested, 60, 0))


def test_cuts_at_headings_first():
    part = "\n".join(f"- item {i} of this list" for i in range(12))
    text = "\n\n".join(f"# Part {k}\n\n{part}" for k in range(4))
    pieces = check(text, 100, 0)
    assert len(pieces) == 4 and all(text[a:b].startswith("# Part") for a, b, _, _ in pieces)


def test_overlap_is_exact_in_prose():
    text = " ".join(f"Sentence {i} tells of a payment that came late." for i in range(200))
    pieces = check(text, 100, 20)
    assert all(E.count(text[a : a + shared]) == 20 for a, _, _, shared in pieces[1:])


def test_bad_limits():
    with pytest.raises(ValueError):
        Splitter(E, 10, 10)


def test_documents(spark):
    texts = [None, "", "short", "word " * 500, "word " * 500, "y" * 9_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    limits = [("small", "byte_bpe_50k", 50, 5), ("large", "byte_bpe_50k", 2_000, 0)]
    rows = split_documents(df, limits).collect()
    assert {r["doc_id"] for r in rows if r["limit_name"] == "small"} == {3, 4, 5}
    assert {r["doc_id"] for r in rows if r["limit_name"] == "large"} == {i for i, t in enumerate(texts) if t and E.count(t) > 2_000}
    assert all(r["piece"] == texts[r["doc_id"]][r["start"] : r["end"]] for r in rows)
    assert sorted(r["doc_id"] for r in oversized(df, limits, "small").collect()) == [3, 4, 5]
    assert split_documents(df.limit(0), limits).count() == 0


def test_overlap_is_the_most_below_it():
    text = "".join(f"第{k}番は二重に請求されました。手数料と税金は別々に計上されています。" for k in range(30))
    for overlap in (11, 12, 14, 16):
        pieces = Splitter(E, 60, overlap).split(text)
        for (before, *_), (a, b, _, shared) in zip(pieces, pieces[1:]):
            end = a + shared
            # Tokens of every start from the piece before on that leaves this piece within the limit.
            can = [n for n in (E.count(text[x:end]) for x in range(before, end + 1) if E.count(text[x:b]) <= 60) if n <= overlap]
            assert E.count(text[a:end]) == max(can)
