"""Problem 5: deduplicating new batches against all history.

A segment index for edit distance: every accepted number is stored by segments, keyed by position and length. A batch
probes the index with the matching substrings of its own numbers, candidates are verified with a bounded edit distance,
and the batch's segments are appended.

A number is cut into three segments, the outer two of equal length and the middle one of at least two characters.
One slip (a character changed, dropped, added, or two neighbours swapped) can't touch both outer segments, so it is
enough to store and probe these two; they lie at the start and at the end of the other number whatever its length.

The index lies in bucket files by its key. A batch is shuffled to the buckets, what was accepted before is read where it
lies and never moved, and only numbers whose account and amount were seen before, or occur again in the batch, probe it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import reference_key
from ..operators.graph import components
from ..operators.state import State, deal
from ..session import cut, remove, scratch_path, written

_GROUP = ["table_name", "account", "cents"]
_NODE = [*_GROUP, "field", "num"]
_PLACE = ["segment", *_GROUP, "field"]
#: Weekly deliveries that are taken in together when history is accepted from its beginning.
DELIVERIES = 26


def one_slip(a: Column, b: Column) -> Column:
    """True where the texts differ by one slip: one character changed, dropped or added, or two neighbours swapped."""
    swaps = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (a != b) & ((F.levenshtein(a, b, 1) == 1) | F.when((F.length(a) == F.length(b)) & (F.length(a) > 1), swaps).otherwise(False))


def numbered(df: DataFrame, table: str, money: str, fields: list[str], *others: str) -> DataFrame:
    """Rows as the index takes them: table_name, row_id, account, cents, numbers (an array of keys, one per field), and other columns."""
    keys = [reference_key(F.col(f)).alias(f"n{k}") for k, f in enumerate(fields)]
    return df.select(F.lit(table).alias("table_name"), "row_id", F.col("merchant_id").alias("account"), (F.col(money) * 100).cast("long").alias("cents"), F.array(*keys).alias("numbers"), *others)


def _outer(length: Column) -> Column:
    """Length of the outer segments of a number of so many characters."""
    return F.greatest(F.floor((length - 2) / 2), F.lit(0)).cast("int")


def _hashed(at: str, text: Column) -> Column:
    """A segment as a number; its length is the text's."""
    return F.hash(F.lit(at), text)


def stored_segments(nodes: DataFrame) -> DataFrame:
    """(segment, node, first) of both outer segments of every number."""
    n, size = F.col("num"), _outer(F.length("num"))
    both = F.array(_hashed("L", F.substr(n, F.lit(1), size)), _hashed("R", F.substr(n, F.length(n) - size + 1)))
    return nodes.select(F.explode(F.array_distinct(both)).alias("segment"), *_NODE, "first")


def _probes(nodes: DataFrame) -> DataFrame:
    """The substrings at which a number meets those one slip away: the outer segments of numbers as long, one shorter, one longer."""
    n, length = F.col("num"), F.length("num")
    parts = []
    for d in (-1, 0, 1):
        size = _outer(length + d)
        parts += [_hashed("L", F.substr(n, F.lit(1), size)), _hashed("R", F.substr(n, length - size + 1))]
    return nodes.select(F.explode(F.array_distinct(F.array(*parts))).alias("segment"), *_NODE, "first")


class History:
    """What was accepted so far, in a folder that a new process goes on from.

    groups: the accounts and amounts seen, as hashes. index: (segment, table_name, account, cents, field, num, first), the
    segments of every distinct number of an account and amount with the row that brought it first. links: (table_name, b, a),
    a row and an earlier one of the same transaction.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        place = "segment INT, table_name STRING, account STRING, cents BIGINT, field INT"
        self.state = State(spark, path, {"groups": ("g BIGINT", ["g"]), "index": (f"{place}, num STRING, first BIGINT", _PLACE), "links": ("table_name STRING, b BIGINT, a BIGINT", ["b"])}, buckets)

    def accept(self, rows: DataFrame, note: dict | None = None) -> DataFrame:
        """Hold a batch (``numbered``) against history and itself, append it, return its links (table_name, b, a).

        Rows without account or money are never repeats and aren't stored.
        """
        work = scratch_path(self.state.spark, "turn")
        with self.state.turn() as left:
            left |= note or {}
            rows = rows.where(F.col("account").isNotNull() & F.col("cents").isNotNull()).withColumn("account", F.col("account").cast("string")).withColumn("g", F.xxhash64(*_GROUP))
            groups = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).hint("shuffle_hash").join(self.state.log("groups").select("g", F.lit(True).alias("old")), "g", "left"), f"{work}/groups")
            # Hashes that groups share do no harm: numbers of different groups never meet.
            shared = groups.select("g", (F.coalesce("old", F.lit(False)) | (F.col("n") > 1)).alias("shared"))
            marked = written(rows.join(shared.hint("shuffle_hash"), "g").drop("g"), f"{work}/rows")
            each = marked.select("table_name", "row_id", "account", "cents", "shared", F.posexplode("numbers").alias("field", "num")).where("num IS NOT NULL")
            busy = each.where("shared")
            nodes = busy.groupBy(*_NODE).agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n"))
            own = nodes.withColumn("segment", _hashed("L", F.substr(F.col("num"), F.lit(1), _outer(F.length("num")))))
            held = self.state.log("index").select(*_PLACE, F.col("num").alias("known"), F.col("first").alias("old"))
            # Equal texts are told by two beginnings: as a key of the join the number would have the index moved.
            same = [own[c] == held[c] for c in _PLACE] + [F.startswith(held["known"], own["num"]), F.startswith(own["num"], held["known"])]
            nodes = written(own.hint("shuffle_hash").join(held, same, "left").select(*[own[c] for c in _NODE], "first", "n", "old"), f"{work}/nodes")
            new = nodes.where("old IS NULL").select(*_NODE, "first")
            # A number of an account and amount that occur once is a number of its own.
            lone = each.where("NOT shared").select(*_NODE, F.col("row_id").alias("first"))
            self.state.append(index=stored_segments(new.unionByName(lone)), groups=groups.where("old IS NULL").select("g"))
            # The same number again: rows that aren't the first of their node.
            again = nodes.where("n > 1 OR old IS NOT NULL").select(*_NODE, F.coalesce("old", "first").alias("first"))
            exact = busy.join(again.hint("shuffle_hash"), _NODE).where("row_id <> first").select("table_name", F.col("row_id").alias("b"), F.col("first").alias("a"))
            # A number but for one slip: probes of the batch's new numbers.
            held = self.state.log("index").select(*_PLACE, F.col("num").alias("known"), F.col("first").alias("a"), "turn")
            met = _probes(new).hint("shuffle_hash").join(held, _PLACE).where((F.col("turn") < self.state.now) | (F.col("a") < F.col("first"))).where(one_slip(F.col("known"), F.col("num")))
            near = met.select("table_name", F.greatest("a", "first").alias("b"), F.least("a", "first").alias("a"))
            self.state.append(links=exact.unionByName(near))
            now = self.state.now
        remove(self.state.spark, work)
        return self.links().where(F.col("turn") == now).drop("turn")

    def links(self) -> DataFrame:
        """All links so far, with the turn that found them."""
        return self.state.log("links")


def first_rows(links: DataFrame) -> DataFrame:
    """(table_name, row_id_a, row_id_b): for every row that repeats a transaction, the first row of it.

    Being the same transaction is carried on: a row may repeat one that repeats the first. A copy of a transaction has
    one link to its first row; only links between first rows make a graph, so a group of copies stays a flat star.
    """
    star = links.groupBy("table_name", "b").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count(F.lit(1)).alias("n"))
    heads = links.select("table_name", F.col("a").alias("id")).distinct()
    many = star.where("lo <> hi").select(F.col("b").alias("id"))
    core = links.join(heads.select("id").unionByName(many).distinct(), F.col("b") == F.col("id"), "left_semi")
    roots = components(core.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    leaf = star.join(roots.select(F.col("id").alias("lo"), F.col("component")), "lo", "left")
    out = leaf.select("table_name", F.coalesce("component", "lo").alias("row_id_a"), F.col("b").alias("row_id_b"))
    # A first row may turn out to repeat another one, by a later row that is linked with both.
    late = heads.join(roots, "id").select("table_name", F.col("component").alias("row_id_a"), F.col("id").alias("row_id_b"))
    return out.unionByName(late).where("row_id_a < row_id_b").distinct()


def accept_deliveries(rows: DataFrame, history: History, of: str = "batch_no", at_once: int = DELIVERIES) -> None:
    """Has ``rows`` accepted delivery by delivery, ``at_once`` of them a turn; turns taken in already are passed over. Rows without a delivery count as of delivery 0."""
    done = max((note.get("number", -1) for note in history.state.taken().values()), default=None)
    rows = rows.withColumn("of", F.floor(F.coalesce(of, F.lit(0)) / at_once).cast("int")).drop(of)
    if done is not None:
        rows = rows.where(F.col("of") > done)
    spark, folder = rows.sparkSession, scratch_path(rows.sparkSession, "dealt")
    rows = deal(rows, folder)
    # One number per turn.
    for k in sorted(r["of"] for r in rows.select("of").distinct().collect()):
        history.accept(rows.where(F.col("of") == k).drop("of"), {"number": k})
    remove(spark, folder)


def repeats_found(upi: DataFrame, gateway: DataFrame) -> DataFrame:
    """(table_name, row_id_a, row_id_b) of every wallet and gateway row that repeats a transaction, the rows accepted by their deliveries."""
    rows = numbered(upi, "upi_wallet_txns", "amount", ["transaction_id", "reference_utr"], "batch_no").unionByName(numbered(gateway, "gateway_settlements", "net_amount", ["utr"], "batch_no"))
    history = History(upi.sparkSession, scratch_path(upi.sparkSession, "history"))
    accept_deliveries(rows, history)
    return first_rows(history.links().drop("turn"))
