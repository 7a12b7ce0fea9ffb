"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents of equal shingle sets form a class, and classes are linked. Let ``least`` be the overlap that any partner of a
set of n shingles must have. Of two linked sets, the first n - least + k shingles of each, in any one order, share k or
more; so k matches in such prefixes are asked for before two sets are compared.

* Level 1, all sets: order by hash, k growing with n (``level_one`` and one more per ``lengthen`` shingles), so that some
  lines and turns of phrase in common are not enough; runs of few words need more of them, as they meet more often by
  chance. A set of which fewer than k prefix shingles are shared at all drops out. The holders of the
  prefix shingles among the others give each set's expected candidates. Sets whose cost is below ``cheap`` times the
  prefix length meet all others here: their candidates are few.
* Level 2, the costly sets among themselves: shingles are ordered from the rarest on. What meets in the prefixes for
  ``level_two`` matches is compared with the most central set of each shingle's holders first; sets tied to one centre
  have its label. Only pairs can be new whose labels differ, and one side of them has not the shingle's most frequent
  label. Those that ``level_two`` matches leave are a set's candidates, and then each set takes a k of its own. A k costs
  the postings of other labels in its prefix, and its candidates (at most those found, and at most postings / k, as each
  holds k of them) times what comparing two whole sets takes; k is doubled up to ``DOUBLINGS`` values, as far as the set's
  least overlap goes, and the cheapest one is taken. The prefix is longer by as much, and a pair is compared only with the
  smaller k of the two in common. A set with more unshared shingles than its partners may lack drops out, and so does a
  pair of which one side shares too little. Every pair that is left is compared: nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, stored
from tidemark.llm.components import components
from tidemark.llm.text import LOWER, mix, parts, shingles, span_hashes, utf8, word_places

#: Bits of the filter that picks the rows whose sets are wanted; it has this size however many they are.
FILTER_BITS = 1 << 23
#: The values of k that a costly set chooses from, each twice the one before.
DOUBLINGS = 5


@dataclass(frozen=True)
class JaccardRule:
    """Runs of ``words`` words; linked if ``of`` * intersection >= ``at_least`` * union.

    ``compare`` is what a shingle of two compared sets costs, in postings read.
    """

    words: int = 5
    at_least: int = 80
    of: int = 100
    level_one: int = 3
    lengthen: int = 20
    level_two: int = 2
    cheap: int = 8
    compare: float = 0.25

    def least(self, n):
        """The overlap that a set of n needs at least; for numbers, arrays and columns."""
        return (n * self.at_least + (self.of - 1)) // self.of

    def first(self, n: np.ndarray) -> np.ndarray:
        """The matches asked for at level 1."""
        return np.minimum(self.least(n), self.level_one + n // self.lengthen)

    def first_sql(self, n: str) -> str:
        return f"least({self.least_sql(n)}, {self.level_one} + ({n}) div {self.lengthen})"

    def least_sql(self, n: str) -> str:
        return f"(({n}) * {self.at_least} + {self.of - 1}) div {self.of}"

    def both_sql(self, a: str, b: str) -> str:
        """The overlap that two sets of these sizes need."""
        return f"(({a} + {b}) * {self.at_least} + {self.of + self.at_least - 1}) div {self.of + self.at_least}"


def _sets(batch: pa.RecordBatch, text_col: str, words: int):
    """Distinct shingles of every row in the order of their hashes: (values, row starts)."""
    data, offsets = utf8(batch[text_col])
    data = LOWER[data]
    starts, ends, rows = word_places(data, offsets)
    h, rows = shingles(span_hashes(data, starts, ends), rows, batch.num_rows, words)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[new], rows[new]
    return h, np.searchsorted(rows, np.arange(batch.num_rows + 1))


def _nodes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each set, equal for equal sets."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(seed)), out=total[1:])
        out.append(mix(total[starts[1:]] - total[starts[:-1]] + np.diff(starts).astype(np.uint64)))
    return np.stack(out, axis=1)


def _binary(nodes: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array([None if gone else x.tobytes() for x, gone in zip(nodes, null)], pa.binary())


def _head(h: np.ndarray, starts: np.ndarray, most: np.ndarray) -> pa.Array:
    """The first values of each set, as lists."""
    sizes = np.diff(starts)
    take = np.minimum(sizes, most)
    keep = np.arange(len(h)) - np.repeat(starts[:-1], sizes) < np.repeat(take, sizes)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(h[keep].view(np.int64))
    )


def _read(docs: DataFrame, rule: JaccardRule, id_col: str, text_col: str, rest: str, make) -> DataFrame:
    """Rows (id, ...) that ``make`` draws from the sets of each part of a batch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "body"):
            yield make(batch["id"], *_sets(batch, "body", rule.words))

    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    return d.mapInArrow(read, f"id {d.schema['id'].dataType.simpleString()}, {rest}")


def _class_rows(docs: DataFrame, rule: JaccardRule, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, class): per row the text's hash, the set's size, and two numbers that equal sets have in common (null if empty)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "body"):
            h, starts = _sets(batch, "body", rule.words)
            n = np.diff(starts)
            columns = [batch["id"], batch["key"], pa.array(n), _binary(_nodes(h, starts), n == 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "n", "class"])

    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body")).withColumn("key", _key(F.col("body")))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(read, f"id {kind}, key long, n long, class binary")


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _bit(node: Column) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 3)), 16, 10).cast("long") % FILTER_BITS


def _named(frame: DataFrame, id_col: str) -> DataFrame:
    """With ``name``, by which null ids can be joined as well."""
    return frame.withColumn("name", F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def _of_classes(drawn: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """(node, n, ``column``) once for each class, from the row of its least id; rows may be repeated."""
    reps = _named(classes, "rep").select("class", "name", "node", "n")
    kept = _named(drawn, "id").drop("id").join(reps, ["class", "name"])
    return kept.dropDuplicates(["class", "name"]).select("node", "n", column)


def _heads(docs: DataFrame, classes: DataFrame, rule: JaccardRule, id_col: str, text_col: str) -> DataFrame:
    """(node, n, head): the prefix of every class by hash."""

    def make(ids: pa.Array, h: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        n = np.diff(starts)
        head = _head(h, starts, n - rule.least(n) + rule.first(n))
        return pa.RecordBatch.from_arrays([ids, _binary(_nodes(h, starts), n == 0), head], names=["id", "class", "head"])

    drawn = _read(docs, rule, id_col, text_col, "class binary, head array<long>", make)
    return _of_classes(drawn, classes, "head")


def _wanted_sets(docs: DataFrame, wanted: DataFrame, rule: JaccardRule, id_col: str, text_col: str) -> DataFrame:
    """(node, n, tokens) of the wanted classes: the texts are read again where they are.

    A bit filter of fixed size goes to the readers, and what passes it is joined with the wanted rows.
    """
    found = (
        wanted.select(_bit(F.col("class")).alias("at"))
        .select(F.expr("at div 63").alias("word"), F.pow(F.lit(2), F.col("at") % 63).cast("long").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 63 + 1, np.int64)
    for row in found:
        bits[row.word] = row.bits
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make(ids: pa.Array, h: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        n = np.diff(starts)
        nodes = _nodes(h, starts)
        first = nodes.view(np.uint8).reshape(-1, 16)[:, :3].astype(np.int64)
        at = ((first[:, 0] << 16) + (first[:, 1] << 8) + first[:, 2]) % FILTER_BITS
        pick = (n > 0) & (shared.value[at // 63] >> (at % 63) & 1 > 0)
        sets = _head(h[np.repeat(pick, n)], np.concatenate([[0], np.cumsum(n[pick])]), n[pick])
        return pa.RecordBatch.from_arrays(
            [ids.filter(pa.array(pick)), _binary(nodes[pick], n[pick] == 0), sets], names=["id", "class", "tokens"]
        )

    drawn = _read(docs, rule, id_col, text_col, "class binary, tokens array<long>", make)
    return _of_classes(drawn, wanted, "tokens")


def _linked(pairs: DataFrame, sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(both * rule.of >= (F.col("n_a") + F.col("n_b") - both) * rule.at_least)
        .select("a", "b")
    )


def _shared(postings: DataFrame) -> DataFrame:
    """The postings (node, token, ...) of shingles that two sets or more hold, with their number ``df``."""
    df = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    return postings.join(df, "token")


def _cheap_pairs(shared: DataFrame, nodes: DataFrame, rule: JaccardRule) -> DataFrame:
    """Pairs with matches enough at level 1, one side of which is cheap."""
    rows = shared.join(nodes, "node")
    one = rows.filter("not costly").select("token", *[F.col(c).alias(f"{c}_1") for c in ("node", "n")])
    pairs = rows.join(one, "token").filter(
        "node <> node_1 and (costly or node < node_1)"
        f" and least(n, n_1) >= {rule.least_sql('greatest(n, n_1)')}"
    )
    return (
        pairs.groupBy(F.least("node", "node_1").alias("a"), F.greatest("node", "node_1").alias("b"))
        .agg(F.count("*").alias("matches"), F.min(F.least("n", "n_1")).alias("n"))
        .filter(f"matches >= {rule.first_sql('n')}")
        .select("a", "b")
    )


def _doublings(rule: JaccardRule) -> list[int]:
    return [rule.level_two << i for i in range(DOUBLINGS)]


def _place(rule: JaccardRule) -> Column:
    """A posting is in its set's prefix for k matches if this is below k."""
    return F.expr(f"rank - common + {rule.least_sql('n')}")


def _others(held: DataFrame, rule: JaccardRule) -> DataFrame:
    """(token, label, main, others): by k, the sets of other labels that have the token in their prefixes; the main label.

    Sets of one label are linked already, so that these are what a set meets at the token.
    """
    doublings = _doublings(rule)
    same = stored(
        held.groupBy("token", "label").agg(*[F.count(F.when(_place(rule) < k, 1)).alias(f"same_{k}") for k in doublings])
    )
    most = F.max(F.struct(f"same_{doublings[-1]}", "label"))["label"].alias("main")
    all_sets = same.groupBy("token").agg(most, *[F.sum(f"same_{k}").alias(f"all_{k}") for k in doublings])
    others = F.array(*[F.col(f"all_{k}") - F.col(f"same_{k}") for k in doublings])
    return same.join(all_sets, "token").select("token", "label", "main", others.alias("others"))


def _own_k(held: DataFrame, candidates: DataFrame, rule: JaccardRule) -> DataFrame:
    """(node, k) of the sets for which more matches than the first ones cost least; equal costs go to the smaller k.

    ``candidates`` are the pairs (a, b) of the first prefixes. Without any, a longer prefix saves nothing.
    """
    sides = candidates.select(F.col("a").alias("node")).union(candidates.select("b"))
    found = sides.groupBy("node").agg(F.count("*").alias("found"))
    doublings = _doublings(rule)
    reads = [
        F.sum(F.when(_place(rule) < k, F.col("others")[i]).otherwise(0)).alias(f"read_{k}") for i, k in enumerate(doublings)
    ]
    read = held.join(found, "node").groupBy("node").agg(F.max("n").alias("n"), F.max("found").alias("found"), *reads)
    costs = []
    for k in doublings:
        left = F.least(F.col("found"), F.col(f"read_{k}") / k)
        choice = F.struct((F.col(f"read_{k}") + left * F.col("n") * rule.compare).alias("cost"), F.lit(k).cast("long").alias("k"))
        # a set has no more matches to ask for than its least overlap
        costs.append(choice if k == doublings[0] else F.when(F.expr(rule.least_sql("n")) >= k, choice))
    return read.select("node", F.least(*costs)["k"].alias("k")).filter(F.col("k") > rule.level_two)


def _meetings(held: DataFrame, rule: JaccardRule) -> DataFrame:
    """The pairs (a, b) of different labels with the smaller k of the two in common, in the prefixes for it."""
    apart = held.filter("label <> main").select(
        "token", *[F.col(c).alias(f"{c}_1") for c in ("node", "n", "common", "k", "label", "rank")]
    )
    # the overlap that this very pair needs says how far its first matches may lie from the begin of either side
    need = rule.both_sql("n", "n_1")
    met = held.join(apart, "token").filter(
        "label <> label_1 and (label = main or node < node_1)"
        f" and least(n, n_1) >= {rule.least_sql('greatest(n, n_1)')}"
        f" and rank < common - {need} + least(k, k_1) and rank_1 < common_1 - {need} + least(k, k_1)"
    )
    return (
        met.groupBy(F.least("node", "node_1").alias("a"), F.greatest("node", "node_1").alias("b"))
        .agg(F.count("*").alias("matches"), F.min(F.least("k", "k_1")).alias("k"))
        .filter("matches >= k")
        .select("a", "b")
    )


def _candidates(held: DataFrame, rule: JaccardRule) -> DataFrame:
    """The pairs (a, b) to compare: those of the first prefixes, and of two sets with longer ones what meets in these too."""
    first = held.withColumn("k", F.least(F.lit(rule.level_two).cast("long"), F.expr(rule.least_sql("n"))))
    pairs = cut(_meetings(first.filter(_place(rule) < F.col("k")), rule))
    longer = cut(_own_k(held, pairs, rule))
    again = _meetings(held.join(longer, "node").filter(_place(rule) < F.col("k")), rule).withColumn("again", F.lit(True))
    ends = [longer.select(F.col("node").alias(c), F.col("k").alias(f"k_{c}")) for c in ("a", "b")]
    pairs = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").join(again, ["a", "b"], "left")
    return pairs.filter("k_a is null or k_b is null or again").select("a", "b")


def _costly_links(sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """Links among the costly sets (node, n, tokens) that are enough to join what is joined: stars, then the rest."""
    rare = _shared(sets.select("node", "n", F.explode("tokens").alias("token")))
    ranked = rare.groupBy("node").agg(
        F.max("n").alias("n"), F.count("*").alias("common"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order")
    )
    # ``common`` bounds the overlap with any other set; what is not shared is the rarest and begins the order
    ranked = ranked.withColumn("least", F.expr(rule.least_sql("n"))).filter("common >= least")
    longest = F.least(F.lit(rule.level_two << (DOUBLINGS - 1)).cast("long"), F.col("least"))
    head = F.slice("order", F.lit(1), (F.col("common") - F.col("least") + longest).cast("int"))
    postings = stored(
        ranked.select("node", "n", "common", F.posexplode(F.transform(head, lambda x: x["token"])).alias("rank", "token"))
    )
    lone = (F.col("n") - F.col("common")).alias("lone")
    short = postings.filter(f"rank < common - {rule.least_sql('n')} + {rule.level_two}")
    centre = short.groupBy("token").agg(F.min(F.struct(lone, "node")).alias("centre"), F.count("*").alias("df"))
    centre = centre.filter("df > 1").select("token", F.col("centre.node").alias("centre"))
    spokes = short.join(centre, "token").filter("node <> centre").select("node", "centre").distinct()
    stars = cut(_linked(spokes.select(F.col("node").alias("a"), F.col("centre").alias("b")), sets, rule))
    hubs = ranked.select(F.col("node").alias("b"), lone)
    label = (
        stars.join(hubs, "b")
        .groupBy(F.col("a").alias("node"))
        .agg(F.min(F.struct("lone", "b"))["b"].alias("label"))
    )
    # a centre may be tied to a better one
    up = label.select(F.col("node").alias("label"), F.col("label").alias("above"))
    label = cut(label.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label")))
    held = postings.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    met_by = _others(held, rule).filter("element_at(others, -1) > 0")
    held = stored(held.join(met_by, ["token", "label"]))
    return stars.union(_linked(_candidates(held, rule), sets, rule))


def _components(docs: DataFrame, rule: JaccardRule, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (id, key, n, class), the classes (class, rep, n, node), and the linked ones (node, root)."""
    rows = cut(_class_rows(docs, rule, id_col, text_col))
    classes = cut(
        rows.filter("class is not null").groupBy("class").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    )
    # numbers are shorter than the classes' names; they are written before they are used, so that they stay
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    heads = _heads(docs, classes, rule, id_col, text_col)
    shared = stored(_shared(heads.select("node", F.explode("head").alias("token"))).drop("df"))
    alive = shared.groupBy("node").agg(F.count("*").alias("common")).join(classes, "node")
    alive = cut(alive.filter(f"common >= {rule.first_sql('n')}"))
    shared = stored(_shared(shared.join(alive.select("node"), "node")))
    cost = shared.groupBy("node").agg(F.sum(F.col("df") - 1).alias("cost"))
    length = F.expr(f"n - {rule.least_sql('n')} + {rule.first_sql('n')}")
    nodes = cut(alive.join(cost, "node").withColumn("costly", F.col("cost") > length * rule.cheap).drop("cost", "common"))
    pairs = cut(_cheap_pairs(shared, nodes.select("node", "n", "costly"), rule))
    in_pairs = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    wanted = nodes.filter("costly").select("node").union(in_pairs).distinct().join(nodes, "node")
    sets = stored(_wanted_sets(docs, wanted, rule, id_col, text_col))
    costly = sets.join(nodes.filter("costly").select("node"), "node", "left_semi")
    links = _linked(pairs, sets, rule).union(_costly_links(costly, rule))
    return rows, classes, components(links)


def jaccard_join(
    docs: DataFrame, rule: JaccardRule = JaccardRule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id``, the least id that links reach.

    Words are lower-cased in A-Z and end at white space; a text of fewer words than a shingle has one shingle, and a
    null or wordless text has none, links with nothing and is its own component. Repeated rows and other equal texts
    share a class. A row without an id is linked like others; a component without any id has a null one. Texts are read
    whole; a text must fit a task. Other columns are not read. An empty table gives an empty result.
    """
    rows, classes, roots = _components(docs, rule, id_col, text_col)
    least = roots.join(classes, "node").groupBy("root").agg(F.min("rep").alias("least"))
    tied = roots.join(least, "root").select("node", "least")
    ids = classes.join(tied, "node", "left").select("class", F.coalesce("least", "rep").alias("component_id"))
    out = rows.join(ids, "class", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, rule: JaccardRule = JaccardRule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Of every group of linked rows the one of least id, with all its columns; all other rows stay.

    Groups are of rows, whatever their ids: rows that share an id and not their text stay or go each by its own text. Of
    repeated rows one stays, and so does the first in order of the text's hash of rows that share the least id. Wordless
    texts are in no group. Rows without an id stay: no result can name them.
    """
    rows, classes, roots = _components(docs, rule, id_col, text_col)
    # of a group, the class of least id; of that class, the text of least hash
    least = roots.join(classes, "node").filter("rep is not null").groupBy("root")
    least = least.agg(F.min(F.struct("rep", "class"))["class"].alias("least"))
    gone = roots.join(classes, "node").join(least, "root").filter("class <> least").select("class")
    known = rows.filter("id is not null")
    solid = known.filter("class is not null").join(gone, "class", "left_anti")
    kept = solid.groupBy("class").agg(F.min(F.struct("id", "key")).alias("first")).select("first.id", "first.key")
    kept = kept.union(known.filter("class is null").select("id", "key").distinct())
    d = docs.select(docs[id_col].alias("id"), _key(docs[text_col]).alias("key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    stay = d.filter("id is not null").join(kept, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return stay.union(d.filter("id is null")).select("row.*")
