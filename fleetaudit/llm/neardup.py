"""Near duplicates by bottom-k sketches of one hash function.

1. Every document's set of word shingles is hashed once. Equal sets form a class; only one document
   of each class goes on, so copies cost nothing further.
2. The k smallest hashes of a class, in order, are its sketch. Lists are kept under runs of ``RUN``
   hashes that follow each other in it, not under single ones, so that sets which share frequent shingles
   only do not meet. Two sets with a Jaccard similarity of 0.8 have such a run in common: among the hashes of
   both, at least four are shared for each that is not, so where both sets are held whole (the run may go on
   from the last hash to the first) one always exists; among the ``INDEXED`` smallest of larger sets none does
   with a chance of less than one in a hundred million.
3. Members of a list of up to ``SHORT`` are compared with each other. A longer list (thousands of near
   copies) compares each member with one hub, its smallest id; what these pairs link is contracted. Near copies share
   nearly all of their lists, and with them the hub: lists of one hub go on as one group, which has each member once (a hub
   has at most ``INDEXED`` lists, so that the members to compare are at most so many times those of its longest list).
   Groups that still hold several components compare blocks of members across components, never within one; a pair
   counts in the smallest hub that groups both.
4. Sets that their sketches (192 values) hold whole are settled by them; a block gives no more of such links than
   connect its components. Other pairs whose sketches share less than the need go, the rest are verified on
   their full shingle sets. Verified pairs make components.

Words are runs of other characters than ASCII white space, A-Z in lower case. A text with fewer
words than a shingle is one shingle; a text without words (or null) has an empty set and is linked
with nothing. Rows that repeat an id count as one document that has all their shingles' classes:
ids are expected to be distinct, and each row is returned. Shingles are compared by 54 bits of a
hash, which within a pair of sets errs once in some hundred million million.
"""
from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import discard, folder_within, staged, staged_in
from .components import components
from .repeats import possibly_in
from .text import LOWER, U64, Words, blocks, lists, map_blocks, mix, ragged, text_bytes

RETAINED = 192  # values of the sketch, for the estimate
NEED = 0.63  # share of them that two linked sets have in common at least
INDEXED = 96  # the smallest of them, for the lists
RUN = 4  # of them in a row make a value that lists are kept under
SHORT = 8
BLOCK_MEMBERS = 256


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (54 bits) of each document of a block, and where each set starts."""
    words = Words(offsets, LOWER[data])
    n = len(offsets) - 1
    count = np.diff(words.first)
    scrambled = mix(words.hashes)
    size = np.minimum(width, count)  # short texts: the whole sequence
    number = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    start = np.repeat(words.first[:-1], number) + (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
    long = np.repeat(size, number)
    h = np.zeros(len(start), U64)
    for k in range(width):
        inside = k < long
        h = np.where(inside, (h + scrambled[np.minimum(start + k, max(len(scrambled) - 1, 0))]) * U64(0x9E6C63D0876A9A47 + 2 * k), h) if len(scrambled) else h
    key = (np.repeat(np.arange(n), number).astype(U64) << U64(54)) | (mix(h + long.astype(U64)) >> U64(10))
    key = np.unique(key)
    first = np.searchsorted(key, np.arange(n + 1).astype(U64) << U64(54))
    return (key & U64((1 << 54) - 1)).astype(np.int64), first


def sketches(df: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n`` (set size), ``d1``, ``d2`` (digest of the set) and ``sketch`` (its smallest hashes in order) of every document."""
    def run(batch):
        offsets, data = text_bytes(batch.column(1))
        for i, j in blocks(offsets):
            values, first = shingle_sets(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]], width)
            n = np.diff(first)
            digests = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.append(U64(0), np.cumsum(mix(values.astype(U64) + U64(salt))))
                digests.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            take = np.minimum(n, RETAINED)
            held = lists(np.append(0, np.cumsum(take)), values[ragged(first[:-1], take)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n), pa.array(digests[0]), pa.array(digests[1]), held], ["id", "n", "d1", "d2", "sketch"])
    return map_blocks(df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")),
                      "id long, n long, d1 long, d2 long, sketch array<long>", run)


def run_values(first: np.ndarray, values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``RUN`` hashes of the sketches values[first[i]:first[i + 1]], and how many each sketch has.

    Sets of up to ``INDEXED`` are whole and go on from their last hash to the first. Under ``RUN`` shingles no other set is alike enough.
    """
    number = np.where(n < RUN, 0, np.where(n <= INDEXED, n, INDEXED - RUN + 1))
    place, base, size = ragged(np.zeros(len(n), np.int64), number), np.repeat(first[:-1], number), np.repeat(n, number)
    out = np.zeros(len(place), U64)
    for k in range(RUN):
        out = mix(out * U64(0x9E6C63D0876A9A47) + values[base + (place + k) % size].astype(U64))
    return out.view(np.int64), number


def _runs(heads: DataFrame) -> DataFrame:
    """``value``, ``id``, ``n``: each class with its set size under the runs of its sketch."""
    def run(batch):
        for at in range(0, batch.num_rows, 1 << 11):
            part = batch.slice(at, 1 << 11)
            ids, n, held = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2)
            first = held.offsets.to_numpy().astype(np.int64)
            values, number = run_values(first - first[0], held.flatten().to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(ids, number)), pa.array(np.repeat(n, number))], ["value", "id", "n"])
    return map_blocks(heads.select("id", "n", "sketch"), "value long, id long, n long", run)


def full_sets(df: DataFrame, width: int) -> DataFrame:
    """``id`` and ``shingles`` of the rows (id, text)."""
    def run(batch):
        offsets, data = text_bytes(batch.column(1))
        for i, j in blocks(offsets):
            values, first = shingle_sets(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]], width)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], lists(first, values, pa.int64())], ["id", "shingles"])
    return map_blocks(df.select("id", "text"), "id long, shingles array<long>", run)


def _lists(heads: DataFrame) -> DataFrame:
    """``value``, ``id``, ``n``, ``members``, ``hub``, ``hub_n``: the lists of several members; of those with the same members only that of the smallest value.

    ``hub``: the smallest id of the list, ``hub_n``: its set size. A pair's smallest common value always stays: a list of the same members under a smaller value would hold the pair too.
    """
    rows = _runs(heads)
    # Written, so that both sides of the join are plain shuffles and long lists are split.
    several = staged(rows.groupBy("value").agg(F.count("*").alias("members")).where("members > 1").select("value"), "values")
    rows = staged(rows.join(several, "value", "left_semi"), "rows")
    mark = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    per = rows.groupBy("value").agg(F.count("*").alias("members"), F.min("id").alias("hub"), F.min_by("n", "id").alias("hub_n"), *mark)
    keep = per.groupBy("members", "mark1", "mark2").agg(*[F.min(c).alias(c) for c in ("value", "hub", "hub_n")])
    keep = staged(keep.select("value", "members", "hub", "hub_n"), "kept")
    return rows.join(keep, "value")


def _sizes_fit(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _first_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose sizes leave the threshold possible: all of the short lists, those with the hub of longer ones."""
    short = held.where(f"members <= {SHORT}").select("value", "id", "n")
    each = short.toDF("value", "a", "na").join(short.toDF("value", "b", "nb"), "value").where(F.col("a") < F.col("b"))
    long = held.where(f"members > {SHORT} and id <> hub")
    stars = long.select(F.col("hub").alias("a"), F.col("id").alias("b"), F.col("hub_n").alias("na"), F.col("n").alias("nb"))
    fit = [x.where(_sizes_fit("na", "nb", percent)).select("a", "b", "na", "nb") for x in (each, stars)]
    return fit[0].union(fit[1]).distinct()


def _likely(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave the threshold possible, and whether they are ``sure``: both sets held whole."""
    sketch = near.select("id", "sketch")
    both = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    whole = F.greatest("na", "nb") <= RETAINED
    linked = 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))
    possible = F.col("shared") >= F.floor(F.lit(NEED * percent / 80) * F.least("na", "nb", F.lit(RETAINED)))
    return both.where(F.when(whole, linked).otherwise(possible)).select("a", "b", whole.alias("sure"))


def _verified(likely: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are sure or whose full sets reach the threshold."""
    likely = staged(likely, "likely")
    unsure = likely.where("not sure").select("a", "b")
    wanted = unsure.select(F.explode(F.array("a", "b")).alias("doc"))
    some = possibly_in(texts, wanted)[0]
    sets = staged(full_sets(some.join(wanted.distinct(), some["id"] == F.col("doc"), "left_semi"), width), "sets")
    both = unsure.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    reached = both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")
    return staged(reached.union(likely.where("sure").select("a", "b")), "links")


def _open_groups(named: DataFrame) -> DataFrame:
    """``hub``, ``main`` (the largest component) and ``deal`` (into how many blocks its members go) of groups that hold several components."""
    sizes = named.groupBy("hub", "component").agg(F.count("*").alias("n"))
    per = sizes.groupBy("hub").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("members")).where("parts > 1")
    return per.select("hub", F.col("most.component").alias("main"), F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int").alias("deal"))


def _across(named: DataFrame, per: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sure) of different components that share a group and whose sketches overlap enough.

    ``named``: hub, id, n, component; ``per``: see ``_open_groups``. A group of up to ``BLOCK_MEMBERS`` members is one block and
    meets itself. In a longer one the largest component is dealt into blocks of its own, the other members
    into others; two blocks of the largest component never meet. Of the sure pairs of two blocks enough
    come out to connect the components that they connect, and no unsure one between those.
    """
    held = staged(named.join(per, "hub"), "open")
    groups_of = held.groupBy("id").agg(F.collect_set("hub").alias("indexed"))  # a class has at most ``INDEXED``
    facts = near.select("id", "sketch").join(groups_of, "id")
    rows = held.join(facts, "id")
    rows = rows.withColumn("is_main", F.col("component") == F.col("main")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("deal")).cast("int"))
    gathered = F.collect_list(F.struct("id", "component", "n", "sketch", "indexed", "is_main"))
    short = rows.where("deal = 1").groupBy("hub").agg(gathered.alias("x"))
    # A block has about BLOCK_MEMBERS members, whatever the size of the group.
    grouped = staged(rows.where("deal > 1").groupBy("hub", "is_main", "block").agg(gathered.alias("members")), "blocks")
    a = grouped.where("not is_main").select("hub", F.col("block").alias("i"), F.col("members").alias("x"))
    b = grouped.select("hub", F.col("is_main").alias("m"), F.col("block").alias("j"), F.col("members").alias("y"))
    met = a.join(b, "hub").where("m or i <= j").select("hub", "x", "y")
    met = met.union(short.select("hub", "x", F.lit(None).cast(met.schema["y"].dataType)))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                hub = batch.column(0)[r].as_py()
                left = _members(batch.column(1)[r].values)
                right = _members(batch.column(2)[r].values) if batch.column(2)[r].is_valid else left
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in links_between(left, right, hub, percent)], ["a", "b", "sure"])

    return met.mapInArrow(run, "a long, b long, sure boolean").distinct()


def links_between(left: dict, right: dict, hub: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids a < b of likely pairs of two blocks of the group of ``hub``, and which are sure; see ``_across``."""
    one, other = left["n"][:, None], right["n"]
    fit = (100 * np.minimum(one, other) >= percent * np.maximum(one, other)) & (left["component"][:, None] != right["component"]) & ~left["is_main"][:, None]
    if fit.any():
        shared = _shared(left["sketch"], right["sketch"])
        whole = np.maximum(one, other) <= RETAINED
        possible = shared >= np.floor(NEED * percent / 80 * np.minimum(np.minimum(one, other), RETAINED))
        fit &= np.where(whole, 100 * shared >= percent * (one + other - shared), possible)
    if fit.any():
        fit &= _shared(left["indexed"], right["indexed"], hub) == 0
    i, j = np.nonzero(fit)
    sure = np.maximum(left["n"][i], right["n"][j]) <= RETAINED
    order = np.argsort(~sure, kind="stable")
    i, j, sure = i[order], j[order], sure[order]
    head: dict = {}

    def find(x):
        while head.setdefault(x, x) != x:
            head[x] = x = head[head[x]]
        return x

    take = np.zeros(len(i), bool)
    for k, (c, d, certain) in enumerate(zip(left["component"][i].tolist(), right["component"][j].tolist(), sure.tolist())):
        c, d = find(c), find(d)
        take[k] = c != d
        if certain:
            head[c] = d
    ids, others = left["id"][i[take]], right["id"][j[take]]
    return np.minimum(ids, others), np.maximum(ids, others), sure[take]


def _members(block: pa.StructArray) -> dict:
    """Columns of a block's members; lists as bounds and values."""
    out = {c: block.field(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "n", "is_main")}
    for c in ("sketch", "indexed"):
        held = block.field(c)
        bounds = held.offsets.to_numpy()
        out[c] = (bounds - bounds[0], held.flatten().to_numpy())
    return out


def _shared(x, y, below: int | None = None) -> np.ndarray:
    """Number of values that each list of ``x`` shares with each of ``y``, of those under ``below``."""
    common = np.intersect1d(x[1], y[1])
    if below is not None:
        common = common[common < below]
    marks = []
    for bounds, values in (x, y):
        mark = np.zeros((len(bounds) - 1, len(common)), np.float32)
        if len(common):
            at = np.minimum(np.searchsorted(common, values), len(common) - 1)
            hit = common[at] == values
            mark[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[hit], at[hit]] = 1
        marks.append(mark)
    return marks[0] @ marks[1].T


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept, for every row of ``df``.

    Rows without an id belong to the component of the documents with the same set, but link and stand for none: such a row is
    kept only where no document with an id has its set, and then has no component.
    Shuffled are sketches, retained values and, of classes with a likely partner, their texts.
    ``percent`` must be 80 or more: the bounds on retained values hold from there on.
    """
    if percent < 80:
        raise ValueError("the sketches are sized for thresholds of 80 percent and more")
    wide = folder_within(df.sparkSession, "sketches")
    with staged_in(wide):
        whole = staged(sketches(df, width, key, text), "sketches")
    drawn = staged(whole.drop("sketch"), "drawn")
    real = "n > 0 and id is not null"
    classes = staged(drawn.where(real).groupBy("d1", "d2", "n").agg(F.min("id").alias("id")), "classes")
    copies = staged(drawn.where(real).select("id").distinct().join(classes.select("id"), "id", "left_anti").withColumnRenamed("id", "doc"), "copies")
    some, none = possibly_in(whole.where(real).select("id", "n", "sketch"), copies)
    heads = some.join(copies, some["id"] == copies["doc"], "left_anti").union(none)
    held = staged(_lists(heads), "lists")
    listed = held.select(F.col("id").alias("doc"))
    some, _ = possibly_in(heads.select("id", "sketch"), listed)
    near = staged(some.join(listed.distinct(), some["id"] == F.col("doc"), "left_semi"), "near")
    discard(df.sparkSession, wide)
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    pairs = staged(_first_pairs(held, percent), "pairs")
    found = components(_verified(_likely(pairs, near, percent), texts, width, percent))
    grouped = held.where(f"members > {SHORT}").select("hub", "id", "n").distinct()
    named = staged(grouped.join(found, grouped["id"] == found["node"], "left").select("hub", "id", "n", F.coalesce("component", "id").alias("component")), "named")
    per = staged(_open_groups(named), "several")
    if not per.isEmpty():
        # What the first pairs linked is settled, so their stars stand for it.
        more = _verified(_across(named, per, near, percent), texts, width, percent)
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = classes.join(found, classes["id"] == found["node"], "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("component_id"))
    out = drawn.join(named, ["d1", "d2", "n"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one document of each group of near duplicates: the smallest key, null last; of rows that share it, one.

    Rows without words are in no group and stay. Only rows that may go are shuffled with their texts.
    """
    # How files are packed into partitions follows the cores of the moment, and with it the numbers: they are written once.
    # The caller's columns travel in one, out of the way of all others.
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own")
    rows = staged(df.select(F.monotonically_increasing_id().alias("row"), whole), "numbered")
    texts = rows.select("row", F.col("own")[text].alias("text"))
    found = near_duplicates(texts, width, percent, "row", "text").where("n_shingles > 0")
    # Groups of one row need no decision.
    linked = staged(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "groups")
    several = linked.where("row <> group").select("group").distinct()
    members = linked.join(several, "group", "left_semi").join(rows.select("row", F.col("own")[key].alias("key")), "row")
    order = F.struct(F.col("key").isNull().alias("no_key"), "key", "row")
    first = members.groupBy("group").agg(F.min(order).alias("first"))
    gone = staged(members.join(first, "group").where("row <> first.row").select(F.col("row").alias("doc")), "gone")
    some, none = possibly_in(rows.withColumnRenamed("row", "id"), gone)
    return some.join(gone, some["id"] == gone["doc"], "left_anti").union(none).select("own.*")
