"""Problem 2: variant spellings of names typed by people.

Every canonical rewriting of a name is generated: titles and legal forms set apart, tokens in any order, nicknames and
short forms resolved, a first name as its initial, one character left out of a token (two spellings that are one slip
apart share such a form). The forms are exploded and equi-joined; a pair that shares one is verified and scored by what
the rewriting costs and by its rarity: the fewer parties share a form, the more it tells. A short spelling joins the party
that it reaches by the cheapest kind of rewriting and among these by the rarest form; forms that several parties share
alike join it to none.

Work is done on distinct names only. Whatever number of rows a name has, they are dropped before anything is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut

# Titles before a person's or firm's name.
TITLES = {"mr", "mrs", "ms", "miss", "smt", "shri", "sri", "shree", "dr", "prof", "kumari", "km", "kum", "sh", "mx", "sir", "madam", "messrs"}

# Short names that are no beginnings of the full name.
NICKNAMES = {
    "bob": ["robert"], "bobby": ["robert"], "bert": ["robert", "albert"], "bill": ["william"], "billy": ["william"], "peggy": ["margaret"], "meg": ["margaret"], "maggie": ["margaret"],
    "ned": ["edward"], "ted": ["edward", "theodore"], "teddy": ["edward"], "lottie": ["charlotte"], "charlie": ["charlotte", "charles"], "kit": ["christopher"], "chris": ["christopher"],
    "kate": ["katherine"], "katie": ["katherine"], "kathy": ["katherine"], "liz": ["elizabeth"], "lizzie": ["elizabeth"], "beth": ["elizabeth"], "betty": ["elizabeth"], "mike": ["michael"], "mick": ["michael"],
    "tom": ["thomas"], "tommy": ["thomas"], "jon": ["jonathan"], "john": ["jonathan"], "johnny": ["jonathan"], "ollie": ["oliver"], "dick": ["richard"], "rick": ["richard"], "jim": ["james"], "jack": ["john"],
    "gary": ["gaurav"], "pinky": ["priyanka"], "vicky": ["vikram", "victoria"], "laxmi": ["lakshmi"], "preet": ["gurpreet"], "jo": ["jyothi", "jonathan"], "jyoti": ["jyothi"], "karthi": ["kartik"], "karthik": ["kartik"],
    "krishna": ["balakrishna"], "venky": ["venkatesh"], "bala": ["balakrishna"], "balu": ["balakrishna"], "raju": ["rajesh"], "hari": ["harini"], "nandu": ["nandini"], "prakash": ["omprakash"], "latha": ["hemalatha"],
}

# Legal forms and the ways to write them, after dots are dropped.
LEGAL = {
    "private": "private", "pvt": "private", "p": "private", "limited": "limited", "ltd": "limited", "llp": "llp", "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "corpn": "corp",
    "brothers": "bros", "bros": "bros", "sons": "sons", "llc": "llc", "plc": "plc", "gmbh": "gmbh",
}
_LEGAL_WORDS = ["private", "limited", "incorporated", "corporation", "brothers"]

# Words of trades that are typed short.
TRADE_WORDS = [
    "agency", "associates", "cargo", "carton", "chemicals", "cleaning", "company", "construction", "consulting", "data", "electricals", "electronics", "engineering", "enterprises", "exports", "foods", "forwarders",
    "furniture", "garden", "group", "haulage", "imports", "industries", "international", "logistics", "management", "manufacturing", "media", "merchants", "network", "paper", "press", "printing", "products",
    "property", "services", "solutions", "supplies", "systems", "tax", "technologies", "textiles", "traders", "trading", "transport", "works",
]
TRADE_SHORT = {"co": "company", "clng": "cleaning", "mgt": "management", "mgmt": "management", "mfg": "manufacturing", "prtg": "printing", "tech": "technologies", "techs": "technologies", "intl": "international", "int": "international", "nw": "network", "serv": "services", "svcs": "services", "assoc": "associates", "elec": "electricals", "prop": "property", "prod": "products", "prods": "products", "exp": "exports", "ind": "industries"}


def one_slip_apart(a: str, b: str) -> bool:
    """One character changed, dropped, added, or two neighbours swapped."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > 1 or a == b:
        return False
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    if n < m:
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def _plain(name: str) -> str:
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", name).casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


def parse_person(name: str) -> list[str]:
    """Tokens of a person's name, given names first where a comma says so; without titles and middle initials."""
    # Two names typed without a blank between them show it by a capital.
    before, comma, after = _plain(re.sub(r"(?<=[^\W\d_A-Z]{2})(?=[A-Z][^\W\d_A-Z])", " ", name)).partition(",")
    text = f"{after} {before}" if comma and after.strip() else before
    tokens = re.findall(r"[^\W\d_]+", re.sub(r"['’`]", "", text))
    while len(tokens) > 2 and tokens[0] in TITLES:
        tokens.pop(0)
    if len(tokens) > 1 and tokens[0] in TITLES and len(tokens[1]) > 1:
        tokens.pop(0)
    if len(tokens) > 2:
        long = [t for t in tokens if len(t) > 1]
        tokens = long if len(long) >= 2 else long + [t for t in tokens if len(t) == 1][:1]
    return tokens


@lru_cache(maxsize=100_000)
def _firm_word(token: str) -> tuple[str, str]:
    """(kind, word) of a token of a firm's name: legal, trade or own."""
    if token in LEGAL:
        return "legal", LEGAL[token]
    if token in TRADE_SHORT:
        return "trade", TRADE_SHORT[token]
    if token in TRADE_WORDS:
        return "trade", token
    if len(token) >= 5:
        for word in _LEGAL_WORDS:
            if one_slip_apart(token, word):
                return "legal", LEGAL[word]
        near = [w for w in TRADE_WORDS if len(w) >= 5 and one_slip_apart(token, w)]
        if len(near) == 1:
            return "trade", near[0]
    fits = [w for w in TRADE_WORDS if 2 <= len(token) < len(w) and token[0] == w[0] and _within(token, w)]
    return ("trade", fits[0]) if len(fits) == 1 else ("own", token)


def _within(short: str, word: str) -> bool:
    rest = iter(word)
    return all(c in rest for c in short)


def parse_firm(name: str) -> tuple[list[str], str]:
    """Sorted words of a firm's name, short forms of trades written out, and its legal form ("" if none is named)."""
    text = re.sub(r"['’`./()]", lambda m: " " if m.group() in "()" else "", re.sub(r"(?i)^\s*m\s*/\s*s\b\.?", " ", _plain(name)))
    words, legal = [], []
    tokens = re.findall(r"[^\W_]+", text)
    for k, token in enumerate(tokens):
        kind, word = _firm_word(token)
        if token in ("and", "the", "of"):
            continue
        if kind != "legal" and token not in TRADE_WORDS and token not in TRADE_SHORT and k == len(tokens) - 1 and k > 1 and len(token) >= 2:
            near = [LEGAL[w] for w in LEGAL if len(w) >= 3 and one_slip_apart(token, w)]
            kind, word = ("legal", near[0]) if near else (kind, word)
        (legal if kind == "legal" else words).append(word)
    return sorted(words), " ".join(sorted(set(legal)))


def stem(short: str) -> str:
    """A pet form without its ending: jaggu -> jag, chandu -> chand."""
    base = re.sub(r"(ie|[aiouy])$", "", short)
    base = re.sub(r"([^aeiou])\1$", r"\1", base)
    return base if len(base) >= 2 else short


#: Characters of a long token; a short form has no more than these.
LONG = 40


def _short_of(short: str, full: str) -> float | None:
    """What it costs to read a first name as a short form of another; None if it can't be."""
    if full in NICKNAMES.get(short, ()):
        return 2.0
    if not 2 <= len(short) <= LONG or len(full) < 4 or len(short) >= len(full):
        return None
    if full.startswith(short):
        return 2.2
    return 2.5 if len(short) >= 3 and full.startswith(stem(short)) else None


def _dropped(token: str) -> list[str]:
    """Forms of which two tokens one slip apart share one: the token itself and with a character left out; of a long one its outer halves, which a slip can't touch both."""
    out = [token]
    if len(token) <= LONG + 1:
        out += {token[:i] + token[i + 1 :] for i in range(len(token))}
    if len(token) >= LONG:
        for m in {(len(token) + d - 2) // 2 for d in (-1, 0, 1)}:
            out += [f"{token[:m]}\u0001", f"\u0001{token[-m:]}"]
    return out


def person_cost(a: list[str], b: list[str]) -> float | None:
    """What it costs to read two names of two tokens as one person's; None if they can't be."""
    best = None
    for f1, l1, f2, l2 in ((*a, *b), (*a, b[1], b[0])):
        for x1, y1, x2, y2 in ((f1, l1, f2, l2), (l1, f1, l2, f2)):  # x: given name, y: family name
            if len(y1) < 2 or len(y2) < 2:
                continue
            slip = y1 != y2
            if slip and not (min(len(y1), len(y2)) >= 4 and one_slip_apart(y1, y2)):
                continue
            if x1 == x2:
                cost = 0.0
            elif min(len(x1), len(x2)) == 1:
                cost = 4.0 if x1[0] == x2[0] else None
            else:
                small, big = sorted((x1, x2), key=len)
                cost = min((c for c in (_short_of(small, big), _short_of(big, small)) if c is not None), default=None)
                if not slip and min(len(x1), len(x2)) >= 3 and one_slip_apart(x1, x2):
                    cost = min(1.0, cost or 9.0)
                elif cost is None and not slip:
                    fixed = [n for n in NICKNAMES if one_slip_apart(n, small) and len(n) >= 4 and big in NICKNAMES[n]]
                    cost = 3.5 if fixed else None
            if cost is not None:
                best = min(best if best is not None else 99.0, cost + slip)
    return best


def persons_cost(a: list[str], b: list[str]) -> float | None:
    """As ``person_cost`` for names of any number of tokens: but for one of them they are the same, or one name is the other without one token, or two tokens of it."""
    if len(a) == len(b) == 2:
        return person_cost(a, b)
    rest_a, rest_b = list(a), list(b)
    for t in a:
        if t in rest_b:
            rest_a.remove(t)
            rest_b.remove(t)
    if len(a) != len(b):
        fewer = min(len(a), len(b)) == 2 or (abs(len(a) - len(b)) == 1 and min(len(a), len(b)) > 1)
        return 4.0 if fewer and not (rest_a and rest_b) else None
    if len(rest_a) != 1:
        return None
    small, big = sorted((rest_a[0], rest_b[0]), key=len)
    if len(small) >= (4 if len(a) == 1 else 3) and one_slip_apart(small, big):
        return 1.0
    if len(a) == 1:
        return None
    if len(small) == 1:
        return 4.0 if big[0] == small else None
    return min((c for c in (_short_of(small, big), _short_of(big, small)) if c is not None), default=None)


def person_forms(tokens: list[str]) -> list[tuple[str, str]]:
    """(form, side) of a name's rewritings: side s (a spelling of the same first name), long or short.

    A name of one token has its slips only. In names of three and more any token may be the slipped, short or initial one, and
    any two of the tokens, or all but one, may be the whole name.
    """
    out: set[tuple[str, str]] = set()
    if len(tokens) == 1:
        return sorted((f"T {d}", "s") for d in (_dropped(tokens[0]) if len(tokens[0]) >= 4 else tokens))
    out.add(("M " + " ".join(sorted(tokens)), "short"))
    if len(tokens) > 2:
        out |= {("M " + " ".join(sorted(some)), "long") for n in (2, len(tokens) - 1) for some in combinations(tokens, n)}
        for i, x in enumerate(tokens):
            y = " ".join(sorted(tokens[:i] + tokens[i + 1 :]))
            out |= {("S " + " ".join(sorted([*tokens[:i], d, *tokens[i + 1 :]])), "s") for d in (_dropped(x) if len(x) >= 3 else [x])}
            out.add((f"I {x[0]} {y}", "short" if len(x) == 1 else "long"))
            if len(x) >= 4:
                out |= {(f"P {x[:k]} {y}", "long") for k in range(2, min(len(x), LONG + 1))} | {(f"N {x} {y}", "long")}
            if 2 <= len(x) <= LONG:
                out |= {(f"P {x} {y}", "short"), (f"P {stem(x)} {y}", "short")} | {(f"N {full} {y}", "short") for full in NICKNAMES.get(x, ())}
        return sorted(out)
    for x, y in (tokens, tokens[::-1]):
        if len(y) < 2:
            continue
        family = _dropped(y) if len(y) >= 4 else [y]
        if len(x) == 1:
            out |= {(f"I {x} {d}", "short") for d in family}
            continue
        given = _dropped(x) if len(x) >= 3 else [x]
        out |= {("S " + " ".join(sorted((x, d))), "s") for d in family} | {("S " + " ".join(sorted((d, y))), "s") for d in given}
        out |= {(f"I {x[0]} {d}", "long") for d in family}
        if len(x) >= 4:
            out |= {(f"P {x[:k]} {d}", "long") for k in range(2, min(len(x), LONG + 1)) for d in family} | {(f"N {x} {d}", "long") for d in family}
        if len(x) <= LONG:
            out |= {(f"P {x} {d}", "short") for d in family} | {(f"P {stem(x)} {d}", "short") for d in family if len(x) >= 3}
        names = {full for n in NICKNAMES if n == x or (len(n) >= 4 and one_slip_apart(n, x)) for full in NICKNAMES[n]}
        out |= {(f"N {full} {d}", "short") for full in names for d in family}
    return sorted(out)


def firm_forms(words: list[str]) -> list[tuple[str, str]]:
    """As ``person_forms``: all words, one of them with a character left out or not."""
    out = {("W " + " ".join(words), "s")}
    for k, word in enumerate(words):
        if len(word) >= 4:
            out |= {("W " + " ".join(sorted([*words[:k], d, *words[k + 1 :]])), "s") for d in _dropped(word)}
    return sorted(out)


def firm_cost(a: tuple[list[str], str], b: tuple[list[str], str]) -> float | None:
    """What it costs to read two firm names as one firm's; None if they can't be: their legal forms differ, or more than a slip does."""
    if a[1] != b[1] and a[1] and b[1]:
        return None
    cost = 0.0 if a[1] == b[1] else 4.0
    if a[0] == b[0]:
        return cost
    rest_a, rest_b = list(a[0]), list(b[0])
    for w in a[0]:
        if w in rest_b:
            rest_a.remove(w)
            rest_b.remove(w)
    if len(rest_a) == len(rest_b) == 1 and min(len(rest_a[0]), len(rest_b[0])) >= 4 and one_slip_apart(rest_a[0], rest_b[0]):
        return cost + 1.0
    return None


def node_of(kind: str, name: str) -> str | None:
    """The node of a name: its tokens as they count, one string; None for a name without letters."""
    if kind == "vendor":
        words, legal = parse_firm(name)
        return f"{' '.join(words)}|{legal}" if words else None
    tokens = parse_person(name)
    return " ".join(sorted(tokens)) if tokens else None


def _cost(kind: str, a: str, b: str) -> float | None:
    if kind == "vendor":
        (wa, _, la), (wb, _, lb) = a.rpartition("|"), b.rpartition("|")
        return firm_cost((wa.split(), la), (wb.split(), lb))
    ta, tb = a.split(), b.split()
    return persons_cost(ta, tb)


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield df.assign(node=[node_of(k, n) for k, n in zip(df["kind"], df["name"])]).dropna(subset=["node"])


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = [(k, node, form, side) for k, node in zip(df["kind"], df["node"]) for form, side in (firm_forms(node.rpartition("|")[0].split()) if k == "vendor" else person_forms(node.split()))]
        yield pd.DataFrame(rows, columns=["kind", "node", "form", "side"])


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        out = df.assign(cost=[_cost(k, a, b) for k, a, b in zip(df["kind"], df["a"], df["b"])])
        out["cost"] = out["cost"].astype(float)
        yield out.dropna(subset=["cost"])


#: Links up to this cost make one party; dearer ones only let a short spelling join the one party that it can mean.
SURE = 1.0


def parties(names: DataFrame) -> DataFrame:
    """(kind, name, party) for names (kind, name): which spellings name the same party.

    kind is customer or vendor; repeated rows and other columns count for nothing. Null names and names without letters name
    nobody and are left out. Spellings of one node (equal but for case, blanks, punctuation, titles, order, middle initials,
    written-out trades) are one party's; nodes one slip apart are; short forms and initials, names without their middle name, and
    firms without their legal form join the one party that they reach by the cheapest and rarest rewriting, if several alike
    none. party is a spelling's node.
    """
    spread = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spelled = names.select("kind", "name").where("name IS NOT NULL").distinct()
    spelled = cut(spelled.mapInPandas(_nodes, "kind string, name string, node string"))
    nodes = spelled.select("kind", "node").distinct()
    # A name has a hundred forms; few names must not be made into them by one task.
    forms = cut(nodes.repartition(spread, "kind", "node").mapInPandas(_forms, "kind string, node string, form string, side string"))
    a, b = forms.alias("a"), forms.alias("b")
    meet = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.node") != F.col("b.node")))
    meet = meet.where(((F.col("a.side") == "s") & (F.col("b.side") == "s") & (F.col("a.node") < F.col("b.node"))) | ((F.col("a.side") == "short") & (F.col("b.side") == "long")))
    meet = meet.select("a.kind", F.col("a.node").alias("a"), F.col("b.node").alias("b"), "a.form")
    links = cut(meet.select("kind", "a", "b").distinct().mapInPandas(_verified, "kind string, a string, b string, cost double"))

    tag = lambda c: F.concat_ws("\u0001", "kind", c)
    sure = components(links.where(F.col("cost") <= SURE).select(tag("a").alias("src"), tag("b").alias("dst")))
    head = cut(nodes.withColumn("id", tag("node")).join(sure, "id", "left").select("id", F.coalesce("component", "id").alias("party")))
    # Dear links go from the party of the shorter spelling to what it can mean, by the forms they share.
    dear = meet.join(links.where(F.col("cost") > SURE), ["kind", "a", "b"])
    lone = F.when(F.col("kind") == "vendor", F.col("a").endswith("|")).otherwise(F.length("a") < F.length("b"))
    dear = dear.select("kind", "form", F.floor("cost").alias("tier"), F.when(lone, tag("a")).otherwise(tag("b")).alias("id"), F.when(lone, tag("b")).otherwise(tag("a")).alias("to"))
    dear = cut(dear.distinct())
    # What a spelling can mean may itself be a short spelling that has only one meaning, so readings are settled in rounds.
    while True:
        to = head.select(F.col("id").alias("to"), F.col("party").alias("to_party"))
        open_ = dear.join(head.select("id", F.col("party").alias("of")), "id").join(to, "to").where("of <> to_party").select("kind", "form", "tier", "of", "to_party").distinct()
        # Rarity: how many parties a form can mean.
        shared = open_.select("kind", "form", "to_party").distinct().groupBy("kind", "form").agg(F.count(F.lit(1)).alias("shared"))
        choice = open_.join(shared, ["kind", "form"]).groupBy("of", "to_party").agg(F.min(F.struct("tier", "shared")).alias("score"))
        rank = W.partitionBy("of").orderBy("score", "to_party")
        chosen = choice.withColumn("place", F.row_number().over(rank)).withColumn("next", F.lead("score").over(rank)).where(F.col("place") == 1).where(F.col("next").isNull() | (F.col("next") > F.col("score")))
        chosen = cut(chosen.select("of", "to_party"))
        if chosen.limit(1).count() == 0:
            break
        done = head.join(chosen.select(F.col("of").alias("party")), "party", "left_semi").select("id")
        dear = cut(dear.join(done, "id", "left_anti"))
        joined = components(chosen.select(F.col("of").alias("src"), F.col("to_party").alias("dst")))
        head = cut(head.join(joined.select(F.col("id").alias("party"), "component"), "party", "left").select("id", F.coalesce("component", "party").alias("party")))
    return spelled.withColumn("id", tag("node")).join(head, "id").select("kind", "name", "party")


def party_pairs(members: DataFrame) -> DataFrame:
    """(party_kind, name_a, name_b): all pairs of different spellings of a party, name_a < name_b."""
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.party") == F.col("b.party")) & (F.col("a.name") < F.col("b.name")))
    return pairs.select(F.col("a.kind").alias("party_kind"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b")).distinct()


def typed_names(upi: DataFrame, cash: DataFrame, vendors: DataFrame) -> DataFrame:
    """(kind, name) of the payers and firms in the three tables, each once."""
    one = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    return one(upi, "customer", "customer_name").unionByName(one(cash, "customer", "customer_name")).unionByName(one(vendors, "vendor", "vendor_name")).distinct()


def variants_found(upi: DataFrame, cash: DataFrame, vendors: DataFrame) -> DataFrame:
    return party_pairs(parties(typed_names(upi, cash, vendors)))
