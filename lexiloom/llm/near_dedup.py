"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find.

Documents with equal shingle sets are one node from the start, so copies cost nothing further. In SuperMinHash each element draws
a random order of the slots and offers rank + uniform to the slot at each rank; a slot keeps the least offer. Offers of rank j lie in
[j, j + 1), so once all slots of a set lie below j the set needs no more ranks: all sets of a slice go through rank 0, those
with a slot still open through rank 1, and so on. Bands of the signature are bucket keys.

In a bucket, every node is compared with one centre, its least; what links is joined. Two nodes of a bucket that are in different components
then still have to be compared, and both have met the bucket's centre. With D the symmetric difference of a set and the centre's, the
difference of two sets is that of their D, so the small D are enough to decide. Around a centre, the nodes outside the largest
component are compared with all others in blocks of bounded size: each pair of blocks is one row, and its counts are one matrix product. So every
pair with a shared bucket is decided exactly or lies in one component already, and no list of pairs is ever written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, prepare, quoted, shuffle_parts, slices, small, unused
from .components import components

BANDS, ROWS = 32, 4
#: Bounds of a block around a centre: bytes of differences, and nodes; and the columns of a matrix product.
BLOCK_BYTES, BLOCK_NODES, COLUMNS = 1 << 19, 1024, 2048
#: Children of one parent that are compared under one key.
CHILDREN_PER_KEY = 256
PERCENT = 80
WORDS_KEPT = 150_000
#: Characters of text that are sketched at once: the orders of their elements take a row of slots each.
CHARS_AT_ONCE = 1 << 18
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LAST = 2**63 - 1  # stands for a null id, after all others


class Shingler:
    """Distinct hashes of the k-word shingles of texts."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def words(self, text: str | None) -> np.ndarray:
        """Hashes of the words, A-Z lower-cased and cut at ASCII blanks only (as bytes methods do)."""
        words = (text or "").encode().lower().split()
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    w = words[i]
                    out[i] = known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array(out, dtype=np.uint64)

    def set(self, text: str | None) -> np.ndarray:
        """Sorted; the whole sequence is one shingle if it is shorter than k; empty without words."""
        w = self.words(text)
        size = min(self.k, len(w))
        if not size:
            return w
        n = len(w) - size + 1
        out = np.full(n, np.uint64(size))
        for j in range(size):
            out = mix64((out ^ w[j : j + n]) * GOLDEN + np.uint64(j))
        return np.unique(out)


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """A row of ``slots`` offers for each set; two sets agree in a slot with a chance equal to their Jaccard similarity.

    Rows of empty sets are infinite.
    """
    sizes = np.array([len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), sizes)
    best = np.full((len(sets), slots), np.inf)
    flat = best.ravel()
    rows = orders = None
    for j in range(slots):
        if j:
            open_sets = (best.max(1) >= j) & (sizes > 0)
            if not open_sets.any():
                break
            if rows is None:  # now the elements' orders are needed; so far only their first places are
                rows = np.flatnonzero(open_sets[of])
                orders = np.tile(np.arange(slots, dtype=np.uint16), (len(rows), 1))
                at = np.arange(len(rows))
                orders[at, 0], orders[at, first[rows]] = first[rows], 0
            else:
                stay = open_sets[of[rows]]
                rows, at = rows[stay], at[stay]
            seed, own = h[rows], of[rows]
        else:
            seed, own = h, of
        drawn = mix64(seed + np.uint64((2 * j + 1) * int(GOLDEN) % 2**64))
        offer = j + (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53
        # The place is drawn apart from the offer: the multiply-shift of another mix.
        place = j + ((mix64(drawn ^ GOLDEN) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j:
            slot = orders[at, place].astype(np.int64)
            orders[at, place] = orders[at, j]
            orders[at, j] = slot
        else:
            first = slot = place
        np.minimum.at(flat, own * slots + slot, offer)
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(signatures), 1))
    for i in range(rows):
        keys = mix64(keys * GOLDEN ^ bits[:, :, i])
    return keys.view(np.int64)


def sketch(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(rid, h, n, node, keys) for (rid, h, text): set size, digest of the set, band keys; node and keys are null for an empty set."""

    def run(batches):
        shingler = Shingler(k)
        for b in batches:
            ids, hashes, texts = b["rid"].to_numpy(), b["h"].to_numpy(), b["text"].tolist()
            for start, end in slices(texts, CHARS_AT_ONCE):
                sets = [shingler.set(t) for t in texts[start:end]]
                keys = band_keys(superminhash(sets, bands * rows), bands, rows)
                yield pd.DataFrame({
                    "rid": ids[start:end], "h": hashes[start:end], "n": [len(s) for s in sets],
                    "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "keys": [key if len(s) else None for key, s in zip(keys, sets)],
                })

    return docs.mapInPandas(run, "rid long, h long, n long, node binary, keys array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, members) for (text): the sorted hashes as bytes."""

    def run(batches):
        shingler = Shingler(k)
        for b in batches:
            texts = b["text"].tolist()
            for start, end in slices(texts):
                sets = [s.tobytes() for s in map(shingler.set, texts[start:end])]
                yield pd.DataFrame({"node": [xxhash.xxh3_128_digest(s) for s in sets], "members": sets})

    return docs.mapInPandas(run, "node binary, members binary")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(child, parent, linked, n, diff): whether the pair is linked, the child's size and its symmetric difference with the parent.

    The children of a parent that has many are dealt over several keys, and its set goes to each of them.
    """

    @F.pandas_udf("struct<linked:boolean,n:long,diff:binary>")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            diff = np.setxor1d(x, y, assume_unique=True)
            out.append((_linked(len(x) + len(y), len(diff), percent), len(x), diff.tobytes()))
        return pd.DataFrame(out, columns=["linked", "n", "diff"])

    many = pairs.groupBy("parent").agg(F.ceil(F.count("*") / CHILDREN_PER_KEY).cast("int").alias("keys"))
    keyed = pairs.join(many, "parent").select("child", "parent", F.pmod(F.hash("child"), F.col("keys")).alias("key"))
    left = sets.select(F.col("node").alias("child"), F.col("members").alias("a"))
    right = many.join(sets.select(F.col("node").alias("parent"), F.col("members").alias("b")), "parent")
    right = right.select("parent", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("key"), "b")
    return keyed.join(left, "child").join(right, ["parent", "key"]).select("child", "parent", compare("a", "b").alias("c")).select("child", "parent", "c.*")


def _linked(sizes, diff, percent: int):
    """From the sum of two sets' sizes and the size of their symmetric difference: 100 * intersection >= percent * union."""
    return 100 * (sizes - diff) >= percent * (sizes + diff)


def block_links(one: list, other: list, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between the members (node, component, n, diff) of two blocks around a centre, one for each two components."""
    rows = [*one, *other]
    split = len(one)
    diffs = [np.frombuffer(r["diff"], np.uint64) for r in rows]
    size, n = np.array([len(d) for d in diffs]), np.array([r["n"] for r in rows])
    _, kind = np.unique(np.array([r["component"] for r in rows], dtype=object), return_inverse=True)
    every, of = np.concatenate(diffs), np.repeat(np.arange(len(rows)), size)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.zeros((split, len(rows) - split), np.float32)
    kept = times[column] > 1  # an element of one difference only is in no intersection
    _, column = np.unique(column[kept], return_inverse=True)
    of = of[kept]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((len(rows), COLUMNS), np.float32)
        has[of[a:b], column[a:b] - start] = 1
        shared += has[:split] @ has[split:].T
    apart = size[:split, None] + size[None, split:] - 2 * shared.astype(np.int64)
    found = _linked(n[:split, None] + n[None, split:], apart, percent) & (kind[:split, None] != kind[None, split:])
    x, y = np.nonzero(found)
    _, first = np.unique(kind[:split][x] * len(rows) + kind[split:][y], return_index=True)
    return [(bytes(one[x[i]]["node"]), bytes(other[y[i]]["node"])) for i in first]


def _around_centres(compared: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Links (child, parent) between components, of nodes that were compared with the same centre."""
    met = compared.select(F.col("parent").alias("centre"), F.col("child").alias("node"), "n", "diff").join(component, "node", "left")
    met = met.withColumn("component", F.coalesce("component", "node"))
    share = met.groupBy("centre", "component").agg(F.count("*").alias("nodes"), F.sum(F.length("diff")).alias("bytes"))
    main = F.max_by("component", F.struct("nodes", "component"))
    several = share.groupBy("centre").agg(main.alias("main"), F.count("*").alias("k")).where("k > 1").select("centre", "main")
    side = (F.col("component") == F.col("main")).alias("is_main")
    blocks = share.join(several, "centre").groupBy("centre", side).agg(F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.sum("nodes") / BLOCK_NODES)).alias("blocks"))
    open_nodes = met.join(several, "centre").withColumn("is_main", F.col("component") == F.col("main")).join(blocks, ["centre", "is_main"])
    # A block has about as many members as the bounds allow, whatever the group's size.
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    gathered = cut(open_nodes.groupBy("centre", "is_main", block.alias("block")).agg(F.collect_list(F.struct("node", "component", "n", "diff")).alias("members")))
    one = gathered.where("not is_main").select("centre", F.col("block").alias("at"), F.col("members").alias("one"))
    other = gathered.select("centre", "is_main", "block", F.col("members").alias("other"))
    pairs = one.join(other, "centre").where("is_main or block >= at").select("one", "other")

    def run(batches):
        for b in batches:
            for one, other in zip(b["one"], b["other"]):
                yield pd.DataFrame(block_links(list(one), list(other), percent), columns=["child", "parent"])

    return pairs.repartition(shuffle_parts(pairs.sparkSession)).mapInPandas(run, "child binary, parent binary")


def groups(docs: DataFrame, k: int, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_shingles, component_id, kept.

    Two documents are linked if the intersection of their shingle sets has at least ``percent`` hundredths of the union's size; the
    component is named by its least id. Null and empty texts, and texts of blanks, have no shingles and are linked with nothing. Repeated rows
    have equal sets and one component. A null id comes after all others: it is its component's name only if there is no other, and such a row
    is kept. Extra columns are not read; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType
    back = lambda c: F.when(F.col(c) != LAST, F.col(c)).cast(id_type)
    named = _named(docs, k, percent, id_col, text_col).withColumn("name", F.col("first.rid"))
    return named.select(back("rid").alias(id_col), F.col("n").alias("n_shingles"), back("name").alias("component_id"), (F.col("rid") == F.col("name")).alias("kept"))


def _row_id(id_: Column) -> Column:
    return F.coalesce(id_.cast("long"), F.lit(LAST))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _named(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: rid, the text's hash h, n, and first, the least (rid, h) of its component."""
    prepare(docs.sparkSession)
    own = docs.select(_row_id(F.col(id_col)).alias("rid"), _text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    sketched = cut(sketch(own, k))
    reps = sketched.where("node is not null").groupBy("node").agg(F.min(F.struct("rid", "h")).alias("first"), F.first("keys").alias("keys"))
    keyed = reps.select("node", F.explode("keys").alias("key"))
    centres = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("centre")).where("size > 1")
    bucketed = cut(keyed.join(centres.select("key", "centre"), "key"))
    wanted = cut(bucketed.select("node").distinct().join(reps.select("node", F.col("first.rid").alias("rid")), "node"))
    sets = full_sets(own.join(small(wanted.select("rid").distinct(), 16), "rid").select("text"), k).dropDuplicates(["node"])
    sets = cut(sets.join(wanted.select("node"), "node", "left_semi"))

    pairs = bucketed.where("node != centre").select(F.col("node").alias("child"), F.col("centre").alias("parent")).distinct()
    compared = cut(_compared(pairs, sets, percent))
    links = compared.where("linked").select("child", "parent")
    component = components(links)
    more = cut(_around_centres(compared, component, percent))
    if not more.isEmpty():
        component = components(links.unionByName(more))

    joined = component.join(reps.select("node", "first"), "node")
    names = joined.groupBy("component").agg(F.min("first").alias("name"))
    named = joined.join(names, "component").select("node", "name")
    nodes = reps.select("node", "first").join(named, "node", "left").select("node", F.coalesce("name", "first").alias("first"))
    full = sketched.where("node is not null").select("rid", "h", "n", "node").join(nodes, "node").select("rid", "h", "n", "first")
    empty = sketched.where("node is null").select("rid", "h", "n", F.struct("rid", "h").alias("first"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group, the one with the least id, and of those that share it the one with the least hash of
    the text; of rows that repeat an id and text, one. All columns stay, whatever their names.

    Rows are told apart by id and text: a row goes only if another one of its own group stays, so rows without an id, or with different texts
    under one id, stay unless they are near copies. Rows without an id and without words are linked with nothing and all stay.
    """
    rows = _named(docs, k, percent).where(~((F.col("rid") == LAST) & (F.col("n") == 0)))
    stays = (F.col("rid") == F.col("first.rid")) & (F.col("h") == F.col("first.h"))
    found = cut(rows.groupBy("rid", "h").agg(F.count("*").alias("copies"), F.max(stays).alias("kept")).where("copies > 1 or not kept"))
    rid, h, kept = unused(docs, "_rid", "_h", "_kept")
    mark = found.select(F.col("rid").alias(rid), F.col("h").alias(h), F.col("kept").alias(kept))
    marked = docs.join(small(mark, 24), (_row_id(docs["doc_id"]) == F.col(rid)) & (_text_hash(docs["text"]) == F.col(h)), "left")
    columns = [F.col(quoted(c)) for c in docs.columns]
    once = marked.where(F.col(kept).isNull()).select(*columns)
    again = marked.where(F.col(kept)).dropDuplicates([rid, h]).select(*columns)
    return once.union(again)
