"""N-gram Jaccard self-join by grouped prefixes, as classes of linked documents.

Documents with the same shingle set are one class from the start. With sizes x and y, a Jaccard
similarity of t needs an overlap of t/(1+t)*(x+y), so at most x - ceil(t*x) of a document's shingles
may be missing in its partner.

1. A fixed share of all shingles (chosen by fingerprint) is exchanged; a document with too many
   sampled shingles that no other document has cannot link and is settled. The sets of the others
   are made where the texts are read: a Bloom filter of bounded size tells which texts these are, so
   texts are not exchanged; a semi join of the sets takes the filter's errors back.
2. Of the rest, shingles are ordered by document frequency, rarest first. A document's prefix is its
   first x - ceil(t*x) + 1 shingles; two linked documents share one. Documents with identical prefix
   and size form a group.
3. Groups that share a prefix shingle meet. First every member is verified against its group's first
   member, and every group against the first group of about its size in the list of the shingle: a
   number of pairs in proportion to the lists. What that links is contracted to components. Then group pairs that still
   lie in different components pass the size and position filters and are expanded and verified, so a
   hot list of near copies costs no quadratic work, and no link between components is lost.
4. `jaccard_links` counts every link as well. All links lie inside components, so the sets of each are
   dealt to blocks by size band and hash, and each pair of blocks whose bands may link is one unit that
   counts overlaps by its postings. Only sums leave a unit; its work grows with the pairs that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._exchange import BLOCK, BLOCK_DDL, Packer, distinct_pairs, shared_counts
from ._sketch import BloomFilter
from ._store import keyed_text, materialise, partitions, table
from ._words import _COEF, mix, new_secret, slices

SAMPLE_SHARE = 0.35
BLOCK_SHINGLES = 1 << 18  # of a component's size band; beyond it, the band is dealt to several blocks
EXPANDED = 1 << 22  # postings and cells of overlap counts held at once
SCAN_DDL = f"{BLOCK_DDL}, doc_id long, n long, sampled long, key binary"
SCAN = pa.schema([*BLOCK, ("doc_id", pa.int64()), ("n", pa.int64()), ("sampled", pa.int64()), ("key", pa.binary())])


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = batch["doc_id"]
    return col.fill_null(0).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)


def _wide(b: pa.RecordBatch) -> pa.RecordBatch:
    n = b.num_rows
    return pa.RecordBatch.from_arrays([*b.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=SCAN)


def _scan(k: int, buckets: int, secret: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, later_only=False, counts=True)
        for batch in batches:
            ids, valid = _ids(batch)
            for s in slices(batch["text"], lower=True, secret=secret, lanes=2):
                m = s.hi - s.lo
                text, h, other = s.shingles(k)
                n = np.bincount(text, minlength=m)
                some = np.flatnonzero(n)
                one, two = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
                if len(some):
                    at = np.searchsorted(text, some)
                    one[some] = np.add.reduceat(mix(h + _COEF[50]), at)
                    two[some] = np.add.reduceat(mix(other + _COEF[51]), at)
                pick = (h >> np.uint64(40)) & np.uint64(0xFFFF) < np.uint64(int(SAMPLE_SHARE * 65536))
                sampled = np.bincount(text[pick], minlength=m)
                key = [a.tobytes() + b.tobytes() for a, b in zip(one, two, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), *[pa.nulls(m, pa.binary())] * 3, batch["doc_id"].slice(s.lo, m), pa.array(n), pa.array(sampled), pa.array(key, pa.binary())], schema=SCAN)
                pick &= valid[s.lo + text]
                for b in packer.add(h[pick], ids[s.lo + text[pick]]):
                    yield _wide(b)
        for b in packer.flush():
            yield _wide(b)

    return f


def _sets(k: int, secret: int, maybe: BloomFilter):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe.holds(*_ids(batch))))
            for s in slices(batch["text"], lower=True, secret=secret):
                text, h, _ = s.shingles(k)
                n = np.bincount(text, minlength=s.hi - s.lo)
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(s.lo, s.hi - s.lo), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], names=["doc_id", "n", "hs"])

    return f


def _verify(percent: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b["ha"], b["hb"]
            good = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], names=["a", "b"])

    return f


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("hs").alias("ha"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("hs").alias("hb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInArrow(_verify(percent), "a long, b long")


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, their weights and set sizes; entries (document, fingerprint) in order of both, and in order of the fingerprint."""
    hs = table["hs"].combine_chunks()
    size = pc.list_value_length(hs).to_numpy()
    c = table["c"].to_numpy().view(np.uint64)
    ids, first, at = np.unique(table["doc_id"].to_numpy(), return_index=True, return_inverse=True)
    h = mix(hs.flatten().to_numpy().view(np.uint64) + np.repeat(mix(c), size))
    h, doc = distinct_pairs(h, np.repeat(at, size))
    return ids, table["w"].to_numpy()[first], np.bincount(doc, minlength=len(ids)), doc, h, np.argsort(doc, kind="stable")


def _count_links(percent: int):
    """For applyInArrow over one unit: for each document, the weights of those that it links with."""

    def f(table: pa.Table) -> pa.Table:
        inner = table.filter(pc.equal(table["side"], 0))
        sides = [inner, inner] if len(inner) else [table.filter(pc.equal(table["side"], i)) for i in (1, 2)]
        if not len(sides[0]) or not len(sides[1]):
            return pa.table({"doc_id": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        ids, w, n, doc, h, by_doc = _side(sides[0])
        ids2, w2, n2, doc2, h2, _ = _side(sides[1])
        doc, h = doc[by_doc], h[by_doc]
        lo = np.searchsorted(h2, h, "left")
        met = np.searchsorted(h2, h, "right") - lo
        first = np.searchsorted(doc, np.arange(len(ids) + 1))
        upto = np.r_[0, np.cumsum(met)][first]
        links, links2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
        at = 0
        while at < len(ids):
            to = min(int(np.searchsorted(upto, upto[at] + EXPANDED, "right")) - 1, at + EXPANDED // len(ids2), len(ids))
            to = max(to, at + 1)
            e = slice(first[at], first[to])
            m = met[e]
            hit = doc2[np.repeat(lo[e] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())] if m.sum() else np.zeros(0, np.int64)
            cell = np.bincount(np.repeat(doc[e] - at, m) * len(ids2) + hit, minlength=0)
            some = np.flatnonzero(cell)
            x, y, both = some // len(ids2) + at, some % len(ids2), cell[some]
            good = (100 * both >= percent * (n[x] + n2[y] - both)) & (ids[x] != ids2[y])
            np.add.at(links, x[good], w2[y[good]])
            np.add.at(links2, y[good], w[x[good]])
            at = to
        if len(inner):  # each pair was met from both ends
            return pa.table({"doc_id": ids, "links": links})
        return pa.table({"doc_id": np.r_[ids, ids2], "links": np.r_[links, links2]})

    return f


def _links(members: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(doc_id, links) from doc_id, c (its component), n, w (its weight) and hs: the weights of all linked documents."""
    width = max(float(np.log(100 / percent)), 1e-6) * (1 + 1e-9)  # sizes that may link are in the same band or the next
    members = members.withColumn("band", F.floor(F.log("n") / width))
    whole = F.sum("n") <= BLOCK_SHINGLES
    small = members.groupBy("c").agg(whole.alias("small"))
    bands = members.groupBy("c", "band").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).join(small, "c")
    over = bands.select("c", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    under = bands.select("c", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    bands = bands.join(over, ["c", "band"], "left").join(under, ["c", "band"], "left")
    slot = F.expr("pmod(xxhash64(doc_id), blocks)").cast("int")
    dealt = members.join(bands, ["c", "band"]).withColumn("slot", slot)
    # a unit is named by its two blocks, the lower band or slot first
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.xxhash64("c", "band", F.least("slot", i), F.lit(0), F.greatest("slot", i)).alias("unit"), F.when(i == F.col("slot"), 0).when(F.col("slot") < i, 1).otherwise(2).alias("side")))
    up = F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda i: F.struct(F.xxhash64("c", "band", "slot", F.lit(1), i).alias("unit"), F.lit(1).alias("side")))
    down = F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda i: F.struct(F.xxhash64("c", F.col("band") - 1, i, F.lit(1), "slot").alias("unit"), F.lit(2).alias("side")))
    none = F.expr("cast(array() as array<struct<unit: bigint, side: int>>)")
    bucket = F.array(F.struct(F.expr(f"pmod(xxhash64(c), {buckets})").alias("unit"), F.lit(0).alias("side")))
    units = F.when(F.col("small"), bucket).otherwise(F.concat(own, F.coalesce(up, none), F.coalesce(down, none)))
    dealt = dealt.select("doc_id", "c", "w", "hs", F.explode(units).alias("u")).select("u.unit", "u.side", "doc_id", "c", "w", "hs")
    return dealt.groupBy("unit").applyInArrow(_count_links(percent), "doc_id long, links long").groupBy("doc_id").agg(F.sum("links").alias("links"))


def _joined(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, rep), the sets of the representatives that may link, and (rep, component) of those that do."""
    spark = docs.sparkSession
    docs = keyed_text(docs)
    least = lambda n: F.floor((n * percent + 99) / 100).cast("long")  # noqa: E731  ceil(percent * n / 100)

    secret = new_secret()
    scan = materialise(docs.mapInArrow(_scan(k, partitions(spark), secret), SCAN_DDL), "shingle-scan")
    shared = shared_counts(scan.filter("bucket is not null").select(*BLOCK.names), partitions(spark))
    facts = scan.filter("bucket is null").select("doc_id", "n", "sampled", "key")
    classes = facts.filter("n > 0 and doc_id is not null").groupBy("n", "key").agg(F.min("doc_id").alias("rep"))
    facts = facts.join(shared, "doc_id", "left").join(classes, ["n", "key"], "left")
    may = F.col("sampled") - F.coalesce("shared", F.lit(0)) <= F.col("n") - least(F.col("n"))
    facts = materialise(facts.select("doc_id", "n", "rep", may.alias("may")), "shingle-facts")

    reps = facts.filter("may and doc_id = rep").select("doc_id").distinct()
    maybe = BloomFilter.of(reps, "doc_id")
    if maybe.full:  # the filter would let most texts pass, and texts are smaller than sets
        docs = docs.join(reps, "doc_id", "left_semi")
    sets = docs.mapInArrow(_sets(k, secret, maybe), "doc_id long, n long, hs array<long>")
    sets = materialise(sets.join(reps, "doc_id", "left_semi"), "shingle-sets")

    tokens = sets.select("doc_id", "n", F.explode("hs").alias("h"))
    df = tokens.groupBy("h").count().filter("count > 1")
    ordered = tokens.join(df, "h").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("s"))
    ordered = ordered.withColumn("alone", F.col("n") - F.size("s")).withColumn("m", (F.col("n") - least(F.col("n")) + 1 - F.col("alone")).cast("int"))
    ordered = ordered.filter("m > 0").select("doc_id", "n", "alone", F.expr("transform(slice(s, 1, m), x -> x.h)").alias("prefix"))
    same = F.when(F.col("alone") == 0, F.sha2(F.array_join(F.col("prefix").cast("array<string>"), ","), 256)).otherwise(F.col("doc_id").cast("string"))
    ordered = materialise(ordered.withColumn("same", same), "prefixes")
    grouped = ordered.groupBy("n", "same").agg(F.min("doc_id").alias("gid"))
    member = materialise(ordered.select("doc_id", "n", "same").join(grouped, ["n", "same"]).select("doc_id", "gid"), "groups")
    heads = ordered.join(grouped.select(F.col("gid").alias("doc_id")), "doc_id", "left_semi")
    lists = materialise(heads.select(F.col("doc_id").alias("gid"), "n", "alone", F.posexplode("prefix").alias("i", "h")).select("h", "gid", "n", (F.col("alone") + F.col("i")).alias("pos")), "prefix-lists")

    need = lambda x, y: F.floor(((x + y) * percent + 99 + percent) / (100 + percent))  # noqa: E731  least overlap
    fits = (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent) & (1 + F.least(F.col("nx") - F.col("px") - 1, F.col("ny") - F.col("py") - 1) >= need(F.col("nx"), F.col("ny")))
    band = F.floor(F.log("n") / float(np.log(100 / percent)))  # sizes that may link are in the same band or the next
    heads_of = lists.groupBy("h", band.alias("band")).agg(F.min(F.struct("gid", "n", "pos")).alias("head"))
    near = lists.withColumn("band", band).join(heads_of, ["h", "band"]).select("gid", F.col("head.gid").alias("other"), F.col("n").alias("nx"), F.col("head.n").alias("ny"), F.col("pos").alias("px"), F.col("head.pos").alias("py"))
    near = near.filter("gid <> other").filter(fits)
    first = near.select(F.col("other").alias("a"), F.col("gid").alias("b")).unionByName(member.filter("doc_id <> gid").select(F.col("gid").alias("a"), F.col("doc_id").alias("b"))).distinct()
    links = materialise(verified(first, sets, percent), "links")
    found = materialise(components(links), "components")

    part = member.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("gid", F.coalesce("component", "doc_id").alias("c"), "doc_id")
    part = materialise(part, "group-parts")
    units = part.groupBy("gid", "c").count()
    meet = lists.unionByName(heads.join(units.groupBy("gid").count().filter("count > 1").select(F.col("gid").alias("doc_id")), "doc_id", "left_semi").select(F.xxhash64(F.lit("group"), "doc_id").alias("h"), F.col("doc_id").alias("gid"), "n", F.lit(0).cast("long").alias("pos")))
    meet = meet.join(units, "gid").select("h", "gid", "n", "pos", "c", "count")
    mixed = meet.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("h")
    meet = materialise(meet.join(mixed, "h", "left_semi"), "mixed-lists")
    top = meet.groupBy("h", "c").agg(F.sum("count").alias("w")).groupBy("h").agg(F.max_by("c", F.struct("w", "c")).alias("top"))
    left = meet.join(top, "h").filter("c <> top").select("h", "top", F.col("gid").alias("gx"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("c").alias("cx"))
    right = meet.select("h", F.col("gid").alias("gy"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("c").alias("cy"))
    rest = left.join(right, "h").filter("cx <> cy and (cy = top or cx < cy)").filter(fits).select("gx", "cx", "gy", "cy").distinct()
    rest = rest.join(part.select(F.col("gid").alias("gx"), F.col("c").alias("cx"), F.col("doc_id").alias("x")), ["gx", "cx"]).join(part.select(F.col("gid").alias("gy"), F.col("c").alias("cy"), F.col("doc_id").alias("y")), ["gy", "cy"])
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = links.unionByName(materialise(verified(rest, sets, percent), "links"))
    return facts, sets, components(links).select(F.col("node").alias("rep"), "component")


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are split at blanks after lower-casing A-Z; a document's set holds its distinct k-word
    shingles, or its whole sequence where it has fewer words. Null and empty texts have an empty set
    and link with nothing. Two documents link when 100 * overlap >= percent * union.

    docs: doc_id long, text string; other columns are ignored. doc_id names a document: rows that
    repeat it share one component. A null doc_id links with nothing and has a null component.
    An empty table gives an empty table.
    """
    facts, _, final = _joined(docs, k, percent)
    out = facts.join(final, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """As jaccard_classes, with n_links: how many other documents the document links with, equal texts among them.

    Links are counted between representatives of equal sets, each weighted with the size of its class.
    """
    facts, sets, final = _joined(docs, k, percent)
    final = materialise(final, "final-components")
    sizes = materialise(facts.filter("rep is not null and doc_id is not null").select("rep", "doc_id").distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("w")), "class-sizes")
    members = final.join(sizes, "rep").select(F.col("rep").alias("doc_id"), F.col("component").alias("c"), "w")
    links = _links(materialise(sets.join(members, "doc_id"), "linked-sets"), percent, partitions(docs.sparkSession))
    out = facts.join(final, "rep", "left").join(sizes, "rep", "left").join(links.withColumnRenamed("doc_id", "rep"), "rep", "left")
    n_links = F.when(F.col("doc_id").isNull() | F.col("rep").isNull(), F.lit(0).cast("long")).otherwise(F.col("w") - 1 + F.coalesce("links", F.lit(0)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"), n_links.alias("n_links"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op4_jaccard_links(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and the number of its links."""
    return jaccard_links(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2
"""

OP4_LINKS_SQL = OP4_SQL[: OP4_SQL.rindex("SELECT w.doc_id")].rstrip() + """,
q AS (SELECT a AS doc_id, count(*) AS q FROM e GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, coalesce(q.q, 0)::BIGINT AS n_links FROM w LEFT JOIN n USING (doc_id) LEFT JOIN q USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2, 4
"""
