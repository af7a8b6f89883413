"""N-gram Jaccard join by MinHash banding.

1. Every text becomes its set of hashed word n-grams. Rows with equal sets form a
   class of copies; from there on only one representative of each is carried.
2. Representatives get band hashes of a MinHash signature; bands and rows follow
   from the similarity and the target recall. Pairs that share a band hash are the
   candidates.
3. Candidates are verified on the full sets. Representatives tied by bands (to the
   least one of each band group) form components, found without a driver. A
   component of up to ``BLOCK`` sets is one task. In a larger one each band group
   is a task, cut into blocks whose pairs are tasks if it is larger than that, and
   a pair counts in the first band that it shares. A task returns counts of links
   and a spanning forest, never the pairs.
4. Components of the verified links are the classes.

Cases: texts without tokens (null, empty) link to nothing; a text with fewer
tokens than ``n`` is one n-gram of what it has; rows that repeat a doc_id are
separate documents, but of rows with equal doc_id and text ``keep_one`` keeps one at
most; a null doc_id comes last; other columns are ignored (``classes``) or pass
through whatever their names (``keep_one``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import free_name, fresh_dir, map_rows, materialize, read_part, spark_arrow_schema, store
from .graph import components
from .tokens import mix, token_hashes

N, THRESHOLD, RECALL, MOST_HASHES, BLOCK, BLOCK_GRAMS = 5, 0.8, 0.9999, 128, 500, 1_000_000
_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def choose_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """Bands and rows: the longest rows for which bands of them reach ``recall`` at ``threshold``."""
    for rows in range(most, 0, -1):
        bands = most // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            while bands > 1 and 1 - (1 - threshold**rows) ** (bands - 1) >= recall:
                bands -= 1
            return bands, rows
    return most, 1


def gram_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    tok, bounds = token_hashes(texts)
    out = []
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(tok) - n + 1), np.uint64)
        for k in range(n):
            grams += tok[k : k + len(grams)] * _STEP[k]
        grams = mix(grams)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(b - a):
                    short += tok[a + k] * _STEP[k]
                out.append(mix(short * _STEP[60]))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(99)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> list[int]:
    """One hash for each band of the MinHash signature, different between bands."""
    mult, add = _seeds(bands * rows)
    sig = np.full(bands * rows, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for lo in range(0, len(grams), 2048):
            part = grams[lo : lo + 2048, None] * mult + add
            sig = np.minimum(sig, (part ^ (part >> np.uint64(32))).min(0))
        h = np.arange(bands, dtype=np.uint64)
        for r in range(rows):
            h = mix(h * _STEP[3] + sig[r::rows])
    return h.view(np.int64).tolist()


def prepare(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, set_a, set_b, size, bands, grams for every row."""

    def make():
        def run(ids, hashes, texts):
            for doc_id, th, g in zip(ids, hashes, gram_sets(texts, n)):
                with np.errstate(over="ignore"):
                    a, b = int(g.sum(dtype=np.uint64).astype(np.int64)), int(mix(g ^ _STEP[7]).sum(dtype=np.uint64).astype(np.int64))
                yield doc_id, th, a, b, len(g), band_hashes(g, bands, rows) if len(g) else [], g.tobytes()

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, set_a long, set_b long, size int, bands array<long>, grams binary"
    made = map_rows(docs.select("doc_id", F.xxhash64("text").alias("_h"), "text"), make, schema, 256)
    return materialize(made.withColumn("uid", F.monotonically_increasing_id()), "grams")


def carry(sets: DataFrame, dealt: DataFrame) -> DataFrame:
    """The sets of the rows that ``dealt`` (uid, task, side, band, copies) names, once for each time it does.

    The rows' numbers begin with the number of the file they are in. So ``dealt``
    is written by file, each task that reads a file of sets takes what it is asked
    for, and no other set is moved.
    """
    spark = sets.sparkSession
    folder = fresh_dir(spark, "dealt")
    store(dealt.withColumn("file", F.shiftright("uid", 33)), folder, "file", parts=int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = spark_arrow_schema(spark, CARRIED)

    def run(batches):
        where, asked = None, {}
        for b in batches:
            rows: list[tuple] = []
            for k, uid in enumerate(b.column(0).to_pylist()):
                if uid >> 33 != where:
                    where, asked = uid >> 33, {}
                    said = read_part(folder, "file", where, ["uid", "task", "side", "band", "copies"])
                    for u, task, side, band, copies in zip(*(c.to_pylist() for c in said.columns)) if said else ():
                        asked.setdefault(u, []).append((task, side, band, u, copies))
                if mine := asked.get(uid):
                    grams, bands = b.column(1)[k].as_py(), b.column(2)[k].as_py()
                    rows += [(*r, grams, bands) for r in mine]
                if len(rows) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return sets.select("uid", "grams", "bands").mapInArrow(run, CARRIED)


CARRIED = "task long, side int, band int, uid long, copies long, grams binary, bands array<long>"
KEY = ["set_a", "set_b", "size"]


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of ``a`` are at least ``threshold`` alike to which of ``b``: a boolean matrix.

    Intersections are counted for the n-grams that more than one set holds, some
    columns at a time.
    """
    sets = [*a, *b]
    every, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(seen > 1) - 1
    keep = seen[inverse] > 1
    col, row = column[inverse[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    common = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        at = slice(*np.searchsorted(col, [lo, lo + width]))
        dense = np.zeros((len(sets), min(width, int(column[-1]) + 1 - lo)), np.float32)
        dense[row[at], col[at] - lo] = 1
        common += dense[: len(a)] @ dense[len(a) :].T
    size = np.array([len(s) for s in sets], np.float64)
    total = size[: len(a), None] + size[None, len(a) :]
    return common * (1 + threshold) >= threshold * total - 1e-6


def forest(link: np.ndarray) -> np.ndarray:
    """The least index that each index of a symmetric link matrix is connected to."""
    root = np.full(len(link), -1)
    for i in range(len(link)):
        if root[i] < 0:
            now = np.zeros(len(link), bool)
            now[i] = True
            front = now
            while front.any():
                front = link[front].any(0) & ~now
                now |= front
            root[now] = i
    return root


def shared(bands: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Which pairs share a band; with ``band`` >= 0 that it is the first that they share."""
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 50_000):
        same = bands[i[lo : lo + 50_000]] == bands[j[lo : lo + 50_000]]
        out[lo : lo + 50_000] = same.any(1) & ((band < 0) | (same.argmax(1) == band))
    return out


def verify(carried: DataFrame, threshold: float) -> DataFrame:
    """From the rows of ``carry``: (uid, links, root), a row for each uid and task.

    ``side`` is 0 where a block meets itself, else 1 and 2 for the two blocks.
    Tasks' rows come together by a shuffle and a sort, and are taken one task at a time.
    """

    def one(held: list[tuple]):
        side, uid, copies = (np.array([r[k] for r in held]) for k in (1, 3, 4))
        sets = [np.frombuffer(r[5], np.uint64) for r in held]
        bands, band = np.array([r[6] for r in held]), held[0][2]
        if side[0] == 0:
            link = linked(sets, sets, threshold)
            np.fill_diagonal(link, False)
        else:
            left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            link = np.zeros((len(sets), len(sets)), bool)
            if len(left) and len(right):
                cross = linked([sets[i] for i in left], [sets[i] for i in right], threshold)
                link[np.ix_(left, right)] = cross
                link[np.ix_(right, left)] = cross.T
        i, j = np.nonzero(link)
        link[i, j] = shared(bands, i, j, band)
        return uid, link.astype(np.float64) @ copies, uid[forest(link)]

    out = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches):
        held: list[tuple] = []

        def done():
            held.sort(key=lambda r: r[3])
            uid, links, root = one(held)
            return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(links.astype(np.int64)), pa.array(root.astype(np.int64))], schema=out)

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    if held and held[0][0] != row[0]:
                        yield done()
                        held = []
                    held.append(row)
        if held:
            yield done()

    dealt = carried.repartition(F.col("task")).sortWithinPartitions("task")
    return dealt.mapInArrow(run, "uid long, links long, root long")


def deal(reps: DataFrame, banded: DataFrame, block: int, grams: int) -> DataFrame:
    """(uid, task, side, band, copies): which representatives each task compares.

    ``reps``: uid, size, copies. ``banded``: uid, k (number of the band), band; of
    bands that several representatives share.
    """
    low = banded.groupBy("band").agg(F.min("uid").alias("v"))
    group = materialize(components(banded.join(low, "band").select(F.col("uid").alias("u"), "v")), "groups")
    member = materialize(group.join(reps, F.col("node") == F.col("uid")).select("uid", "root", "size", "copies"), "members")
    total = member.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    known = member.join(total, "root").withColumn("small", (F.col("n") <= block) & (F.col("grams") <= grams))
    whole = known.where("small").select("uid", F.xxhash64("root", F.lit(0)).alias("task"), F.lit(0).alias("side"), F.lit(-1).alias("band"), "copies")
    large = materialize(banded.join(known.where("NOT small").select("uid", "size", "copies"), "uid"), "large")
    counts = large.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    cut = counts.select("band", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("grams") / grams)).cast("int").alias("blocks"))
    mine = large.join(cut, "band").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    each = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "uid",
        F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
        F.col("k").alias("band"),
        "copies",
    )
    return whole.union(each)


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES, block: int = BLOCK, grams: int = BLOCK_GRAMS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, class_id (least doc_id of its class), first (whether it is the class's first row, by doc_id and text hash), n_links."""
    bands, rows = choose_bands(threshold, recall, most)
    sets = prepare(docs, n, bands, rows)
    full = sets.where("size > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rep = materialize(full.groupBy(*KEY).agg(F.min("uid").alias("rep"), F.min(order).alias("least"), F.count(F.lit(1)).alias("copies")), "reps")
    banded = full.join(rep.select(F.col("rep").alias("uid")), "uid").select("uid", F.posexplode("bands").alias("k", "band"))
    met = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band")
    several = materialize(banded.join(met, "band"), "banded")
    dealt = deal(rep.select(F.col("rep").alias("uid"), "size", "copies"), several, block, grams)
    found = materialize(verify(carry(full, dealt), threshold), "links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    tied = components(found.where("uid <> root").select(F.col("uid").alias("u"), F.col("root").alias("v")))
    known = rep.join(tied, F.col("rep") == F.col("node"), "left").join(links, F.col("rep") == F.col("uid"), "left").select(*KEY, "least", "copies", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    known = materialize(known, "known")
    top = known.groupBy("root").agg(F.min("least").alias("top"))
    known = materialize(known.join(top, "root").select(*KEY, "top", (F.col("links") + F.col("copies") - 1).alias("n_links")), "classes")
    paired = sets.select("doc_id", "text_hash", *KEY, order.alias("own")).join(known, KEY, "left")
    return paired.select("doc_id", "text_hash", F.coalesce(F.col("top.doc_id"), "doc_id").alias("class_id"), F.coalesce(F.col("top") == F.col("own"), F.lit(True)).alias("first"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Of each class the row with the least doc_id (then text hash), and every row without tokens."""
    found = materialize(classes(docs, **how), "first-rows")
    rows = found.groupBy("doc_id", "text_hash").agg(F.min("first").alias("stays"), F.count(F.lit(1)).alias("n"), F.max(F.col("n_links") > 0).alias("linked"))
    key, text = free_name(docs.columns, "_id"), free_name(docs.columns, "_h")
    named = lambda df: df.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text))
    again = materialize(named(rows.where("stays AND linked AND n > 1")), "equal-rows")
    same = F.xxhash64("text").eqNullSafe(F.col(text)) & docs["doc_id"].eqNullSafe(F.col(key))
    out = docs.join(named(rows.where("NOT stays")), same, "left_anti")
    if again.isEmpty():
        return out
    return out.join(again, same, "left_anti").union(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


#: The definition in SQL: every pair that shares an n-gram, then components by recursion.
ORACLE = rf"""
WITH RECURSIVE tok AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), gram AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS g FROM tok)
), size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT u, v FROM common JOIN size su ON su.doc_id = u JOIN size sv ON sv.doc_id = v WHERE c >= {THRESHOLD} * (su.n + sv.n - c) - 1e-9
), reach AS (
  SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT link.v, reach.r FROM reach JOIN link ON link.u = reach.u
)
SELECT d.doc_id, (SELECT min(r) FROM reach WHERE reach.u = d.doc_id) AS class_id, (SELECT count(*) FROM link WHERE link.u = d.doc_id) AS n_links
FROM documents d
"""
