"""Near-duplicate detection with HyperMinHash.

A document's set holds its distinct 2-word shingles as 64-bit hashes. Documents with equal sets are
one class, standing behind its least id. A class has 256 buckets: in round j every shingle falls, by
hash, into one bucket; a bucket keeps the least remaining hash of the first round that reaches it (later rounds
serve small sets, whose buckets would stay empty), so two sets agree in a bucket as often as their Jaccard
similarity. Of that least hash a bucket stores the count of leading zeros and 10 mantissa bits, 16 bits in all.

42 bands of 6 registers propose candidates; an agreement of 0.8 is missed with a probability below 3e-6. The
similarity estimated from all registers, corrected for registers that collide by chance, drops candidates
more than 4.5 standard errors under the threshold; the rest are compared on their full sets.

Candidates of a band's group are not all its pairs. First each member is compared with the group's least one. Members
that the links so found join need no further comparison, so only groups that still span several components go on,
and there only pairs across components count: the members outside a group's largest component are compared by their
registers with all others, in cells of bounded size. A member of the largest component goes to as many cells as the
others fill, in general one, and one of the others to as many as the largest component fills. The pairs that pass join
components to clusters, which hold all links still missing; there the same is done with the full sets, by products of
incidence matrices. So rows stay near the members where most of a group is linked. Where thousands of texts are all just
below the threshold to each other, all of them are others: their comparisons, and their rows by the cell, grow with the square of the group.

Null texts and texts without words have the empty set and are linked with nothing. Rows with equal
ids count as one document, linked with itself; a null id stands before all others. An empty table gives an
empty result; other columns are ignored by ``find`` and carried along by ``drop_copies``, which keeps of rows
with equal ids the one with the least text. Links whose components take over 60 rounds (paths of some 2^60 documents) raise an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Memo, Tables, cut, documents, map_cells, map_rows, sieve
from .components import components

BUCKETS, BANDS, ROWS, MANTISSA = 256, 42, 6, 10
PERCENT, ERRORS = 80, 4.5
#: Rows of one side of a cell, for registers and for full sets, and bytes of sets there.
BLOCK, EXACT_BLOCK, BLOCK_BYTES = 2048, 512, 16 << 20
FIRST = -(1 << 63)
_U = np.uint64
_WORDS = Memo(xxhash.xxh64_intdigest, 100_000)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the 2-word shingles; a single word is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII capitals and white space alone
    h = np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))
    if len(h) < 2:
        return mix(h * _U(0xC2B2AE3D27D4EB4F))
    return np.unique(mix(h[:-1] * _U(0x9E3779B185EBCA87) + (h[1:] ^ (h[1:] >> _U(29))) * _U(0xD6E8FEB86659FD93)))


def registers(x: np.ndarray) -> np.ndarray:
    """256 registers: leading zeros of the least hash in the bucket, then the mantissa bits."""
    empty = np.iinfo(_U).max
    least = np.full(BUCKETS, empty, _U)
    first, step = 0, max(1, -(-8 * BUCKETS // len(x)))
    while (least == empty).any():
        rounds = np.arange(first, first + step, dtype=_U)[:, None]
        h = mix(x[None, :] + (rounds + _U(1)) * _U(0x9E3779B97F4A7C15))
        np.minimum.at(least, (h >> _U(56)).astype(np.int64).ravel(), ((rounds << _U(48)) | (h & _U(0xFFFFFFFFFFFF))).ravel())
        first += step
    rest = (least & _U(0xFFFFFFFFFFFF)).astype(np.float64) + 1
    power = np.floor(np.log2(rest))
    mantissa = np.floor((rest / np.exp2(power) - 1) * (1 << MANTISSA))
    return ((48 - power).astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)


def bands(regs: np.ndarray) -> list[int]:
    part = regs[: BANDS * ROWS].reshape(BANDS, ROWS).astype(_U)
    h = np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        h = mix(h + part[:, k])
    return h.view(np.int64).tolist()


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that the registers of disjoint sets of n and m elements agree."""
    p = []
    for size in (n, m):
        load = np.maximum(1.0, size / BUCKETS)[:, None]
        edges = 1 - np.exp2(-np.arange(0, 49, dtype=float))[None, :]
        p.append((edges[:, 1:] ** load) - (edges[:, :-1] ** load))
    return (p[0] * p[1]).sum(1) / (1 << MANTISSA)


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of registers that agree."""
    c = chance(n, m)
    return (agree / BUCKETS - c) / (1 - c)


def passes(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sizes and registers leave a link possible."""
    j = PERCENT / 100
    least = j - ERRORS * (j * (1 - j) / BUCKETS) ** 0.5
    ok = (agree >= least * BUCKETS) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))  # the correction only lowers
    ok[ok] = estimate(agree[ok], n[ok], m[ok]) >= least
    return ok


def sketches(docs: DataFrame) -> DataFrame:
    """(_key, n_shingles, _class, _bands) of (_key, _text); the last two are null for the empty set."""
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("_class", T.BinaryType()), T.StructField("_bands", T.ArrayType(T.LongType()))])

    def row(key, text):
        x = shingles(text)
        return (key, len(x), xxhash.xxh3_128_digest(x.tobytes()), bands(registers(x))) if len(x) else (key, 0, None, None)

    return map_rows(docs.select("_key", "_text"), lambda: row, schema)


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, _n, _regs, _set) of the documents among the nodes."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_regs", T.BinaryType()), T.StructField("_set", T.BinaryType())])
    nodes = nodes.select(F.col("node").alias("_key"))
    wanted = sieve(docs, "_key", nodes, "_key").join(nodes, "_key", "left_semi").dropDuplicates(["_key", "_text"])

    def row(key, text):
        x = shingles(text)
        return key, len(x), registers(x).tobytes() if len(x) else None, x.tobytes()

    return map_rows(wanted.select("_key", "_text"), lambda: row, schema).where("_n > 0")


def _matrix(regs) -> np.ndarray:
    return np.frombuffer(b"".join(regs), np.uint16).reshape(-1, BUCKETS)


def sides(pairs: DataFrame, sets: DataFrame, *cols: str) -> DataFrame:
    """The pairs (u, v) with the columns of either side's set, as u_ and v_."""
    of = lambda c: sets.select(F.col("node").alias(c), *(F.col(x).alias(c + x) for x in cols))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", *(c + x for x in cols for c in "uv"))


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose estimate doesn't rule out a link."""
    import pyarrow as pa

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for batch in batches:
            p = batch.to_pandas()
            if len(p):
                agree = (_matrix(p["u_regs"]) == _matrix(p["v_regs"])).sum(1)
                p = p[passes(agree, p["u_n"].to_numpy(), p["v_n"].to_numpy())]
            yield pa.RecordBatch.from_pandas(p[["u", "v"]].astype("int64"), schema=schema, preserve_index=False)

    return sides(pairs, sets, "_n", "_regs").mapInArrow(run, "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links on their full sets."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("link", T.BooleanType())])

    def row(u, v, a, b):
        a, b = np.frombuffer(a, _U), np.frombuffer(b, _U)
        if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
            return u, v, False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return u, v, 100 * both >= PERCENT * (len(a) + len(b) - both)

    return map_rows(sides(pairs, sets, "_set"), lambda: row, schema).where("link").select("u", "v")


def in_cells(rows: DataFrame, n_main, n_other) -> DataFrame:
    """The rows of groups (``main``: of the group's largest component) dealt into cells: _lo, _hi.

    Parts of the largest component meet parts of the others in cells (part, -1 - part), the others' parts meet in (part, part).
    ``n_main``, ``n_other``: the numbers of parts, the first at least 1.
    """
    part = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))
    cell = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    n_main, n_other = n_main.cast("int"), n_other.cast("int")
    a = upto(n_other, lambda i: cell(part(n_main), -1 - i))
    mine = part(n_other)
    b = F.concat(upto(n_main, lambda i: cell(i, -1 - mine)), F.filter(upto(n_other, lambda i: cell(F.least(mine, i), F.greatest(mine, i))), lambda x: x["lo"] != x["hi"]))
    return rows.withColumn("_cell", F.explode(F.when(F.col("main"), a).otherwise(b))).select("*", F.col("_cell.lo").alias("_lo"), F.col("_cell.hi").alias("_hi")).drop("_cell")


def joined_components(comp: np.ndarray, related: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of components that relations of rows join, no more than needed. related(i): which rows i is related to; the largest component's rows don't ask."""
    names, label = np.unique(comp, return_inverse=True)
    own, found = np.bincount(label).argmax(), []
    at = label.copy()  # components joined so far
    for i in np.flatnonzero(label != own):
        js = np.flatnonzero(related(i) & (at != at[i]))
        for k in np.unique(label[js]):
            found.append((int(names[label[i]]), int(names[k])))
        at[np.isin(at, np.unique(at[js]))] = at[i]
    return found


def across(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of components with rows in a common cell that may be linked. rows: key, _lo, _hi, node, component, _n, _regs."""

    def compare(p):
        regs, n = _matrix(p["_regs"]), p["_n"].to_numpy()
        return joined_components(p["component"].to_numpy(), lambda i: passes((regs == regs[i]).sum(1), n, np.full(len(n), n[i])))

    return map_cells(rows.select("key", "_lo", "_hi", "node", "component", "_n", "_regs"), ["key", "_lo", "_hi"], "node", compare, "u long, v long")


def overlaps(some: list[np.ndarray], sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """The sizes of the intersections of some sets with all sets."""
    ids = np.unique(np.concatenate(some)) if some else np.empty(0, _U)
    out = np.zeros((len(some), len(sets)), np.float32)
    places = []
    for group in (some, sets):
        at = np.repeat(np.arange(len(group)), [len(x) for x in group])
        x = np.concatenate(group) if group else ids
        col = np.searchsorted(ids, x)
        hit = (col < len(ids)) & (ids[np.minimum(col, len(ids) - 1)] == x) if len(ids) else np.zeros(len(x), bool)
        order = np.argsort(col[hit], kind="stable")
        places.append((at[hit][order], col[hit][order], len(group)))
    for lo in range(0, len(ids), columns):
        made = []
        for at, col, n in places:
            a, b = np.searchsorted(col, [lo, lo + columns])
            m = np.zeros((n, columns), np.float32)
            m[at[a:b], col[a:b] - lo] = 1
            made.append(m)
        out += made[0] @ made[1].T
    return out


def within(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of components with rows in a common cell that are linked. rows: key, _lo, _hi, node, component, _set."""

    def compare(p):
        sets, comp = [np.frombuffer(x, _U) for x in p["_set"]], p["component"].to_numpy()
        n = np.array([len(x) for x in sets], np.float32)
        label = np.unique(comp, return_inverse=True)[1]
        others = np.flatnonzero(label != np.bincount(label).argmax())
        both = dict(zip(others.tolist(), overlaps([sets[i] for i in others], sets), strict=True))
        return joined_components(comp, lambda i: 100 * both[i] >= PERCENT * (n + n[i] - both[i]))

    return map_cells(rows.select("key", "_lo", "_hi", "node", "component", "_set"), ["key", "_lo", "_hi"], "node", compare, "u long, v long")


def divided(rows: DataFrame, *sums) -> DataFrame:
    """(key, main: the largest component, all, most: rows of the group and of that component; and all_, most_ of each sum) of groups that span components."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.min("node").alias("_m"), *(F.sum(s).alias(s) for s in sums))
    first = F.max(F.struct("n", "component", *sums))
    groups = parts.groupBy("key").agg(F.count("*").alias("_parts"), first.alias("f"), F.sum("n").alias("all"), F.bit_xor("_x").alias("_x"), F.min("_m").alias("_m"), *(F.sum(s).alias(f"all{s}") for s in sums))
    return groups.where("_parts > 1").select("key", F.col("f.component").alias("main"), "all", F.col("f.n").alias("most"), "_x", "_m", *(f"all{s}" for s in sums), *(F.col(f"f.{s}").alias(f"most{s}") for s in sums))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, exact_block: int = EXACT_BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    tables = Tables(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(id_col), F.lit(FIRST)).alias("_key"), F.col(text_col).alias("_text"))
    sketch = tables.put(sketches(base))
    # sums that are joined again are tables, so that the join's shuffles are its own and a hot class or group can be split
    classes = tables.put(sketch.where("n_shingles > 0").groupBy("_class").agg(F.min("_key").alias("node")))
    members = cut(sketch.select("_key", "n_shingles", "_class").join(classes, "_class", "left").select("_key", "n_shingles", "node"))

    # the groups of bands, and their members with all their groups
    reps = sketch.where("n_shingles > 0").groupBy("_class").agg(F.min("_key").alias("node"), F.first("_bands").alias("_bands"))
    rows = reps.select("node", F.explode("_bands").alias("key"))
    groups = tables.put(rows.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("_size")).where("_size > 1").drop("_size"))
    grouped = tables.put(rows.join(groups, "key").groupBy("node").agg(F.collect_list(F.struct("key", "leader")).alias("in")))  # 42 entries a set at most
    tables.drop(sketch, classes, groups)
    sets = tables.put(sets_of(base, grouped))

    # members against their groups' leaders
    pairs = grouped.select(F.col("node").alias("u"), F.explode(F.array_distinct(F.col("in.leader"))).alias("v")).where("u != v")
    candidates = tables.put(likely(pairs, sets))
    own = members.groupBy("_key").agg(F.min("node").alias("_least"), F.max("node").alias("_most")).where("_least != _most")  # ids with several texts
    own = members.join(own, "_key").where("node != _least").select(F.col("node").alias("u"), F.col("_least").alias("v"))
    links = tables.put(confirmed(candidates, sets).union(own))
    nodes = grouped.select("node", F.lit(None).cast("long").alias("component")).union(components(links, tables))
    found = tables.put(nodes.groupBy("node").agg(F.coalesce(F.min("component"), "node").alias("component")))
    tables.drop(candidates, links)

    # groups that still span components; of groups with the same members one
    in_groups = grouped.join(found, "node").select("node", "component", F.explode("in.key").alias("key"))
    mixed = divided(in_groups).groupBy("all", "most", "main", "_x", "_m").agg(F.min("key").alias("key"))
    parts = lambda n, size: F.ceil(F.col(n) / size)
    left = in_groups.join(mixed.select("key", F.col("main").alias("_main"), "most", (F.col("all") - F.col("most")).alias("rest")), "key").withColumn("main", F.col("component") == F.col("_main"))
    left = left.join(sets.select("node", "_n", "_regs"), "node")
    maybe = tables.put(across(in_cells(left, parts("most", block), parts("rest", block))))

    # clusters of components, on full sets
    clusters = tables.put(components(maybe, tables).select(F.col("node").alias("component"), F.col("component").alias("key")))
    rows = found.join(clusters, "component").join(sets.select("node", "_n"), "node")
    spans = divided(rows, "_n").select("key", F.col("main").alias("_main"), "most", "most_n", (F.col("all") - F.col("most")).alias("rest"), (F.col("all_n") - F.col("most_n")).alias("rest_n"))
    rows = rows.drop("_n").join(spans, "key").withColumn("main", F.col("component") == F.col("_main")).join(sets.select("node", "_set"), "node")
    size = lambda n: F.greatest(parts(n, exact_block), F.ceil(F.col(f"{n}_n") * 8 / block_bytes))
    linked = tables.put(within(in_cells(rows, size("most"), size("rest"))))
    roots = components(linked, tables).select(F.col("node").alias("component"), F.col("component").alias("_root"))
    named = cut(found.join(roots, "component", "left").select("node", F.coalesce("_root", "component").alias("_component")))
    tables.drop()

    out = members.join(named, "node", "left").select("_key", "n_shingles", F.coalesce("_component", "node", "_key").alias("_component"))
    plain = lambda c: F.when(F.col(c) != FIRST, F.col(c))
    return out.select(plain("_key").alias(id_col), "n_shingles", plain("_component").alias("component_id"), (F.col("_key") == F.col("_component")).alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the least id, with all its columns."""
    key, own = "__key_of_copies", F.coalesce("doc_id", F.lit(FIRST))
    kept = find(docs.select("doc_id", "text")).where("kept").select(own.alias(key)).distinct()
    rows = docs.withColumn(key, own).join(kept, key, "left_semi")
    first = F.row_number().over(Window.partitionBy(key).orderBy("text", F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))))  # dealt out as the join has it
    return rows.withColumn("__nth_of_copies", first).where("__nth_of_copies = 1").select(*docs.columns)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
