"""Near duplicates by bottom-k sketches of one hash function.

Documents with the same shingle set are one class from the start.  Of each
class the 64 smallest shingle hashes are retained.  Inverted lists of the
retained values generate candidates, the union of two sketches estimates their
Jaccard similarity, and the full sets decide.

All lists are treated alike.  First every node of a list is held against the
node that shares the most values with others; most copies are joined by that.  Then, in lists whose nodes
are not all joined yet, every node is held against every one that it is not
joined with: pair by pair where the list is short, block against block within
tasks where it is long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_sized, only, parts, release, slices, text_rows, unused
from .components import components
from .hashing import mix, window_hashes, word_hashes

STEP = 4 << 20
RETAINED = 64
INDEXED = 48  # of the retained values, those whose lists are looked at
#: Two sets of similarity 0.75 share so many of their 48 smallest hashes, but
#: for a chance of 5.2e-13; smaller sets must share this part of them.
SHARED = 13
#: Estimates from 64 hashes of such sets are below this with a chance of 2.4e-13.
ESTIMATE = 21 / 64
WORDS = 5
GROUP = 96  # partners of a document that one task compares, at most
CROWD = 32  # the longest list whose pairs are written out
PART = 1_280  # nodes of a longer list that meet another such part in one task
BLOCK = 8 << 20  # bytes of text that one task holds of others or of a longer list, twice
WORD = 8  # bytes of text for each shingle, about


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of ``n`` consecutive words; of all words as one if there are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return window_hashes(words, len(words), salt=1)
    return np.unique(window_hashes(words, n))


def sets_of(texts: list[bytes], n: int = WORDS):
    """The shingle set of each text."""
    for i, j in slices([len(t) for t in texts], STEP):
        words, counts = word_hashes(texts[i:j], lower=True)
        ends = np.cumsum(counts)
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            yield shingles(words[a:b], n)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles``, a 128-bit hash of the set and its bottom-64 sketch."""

    def run(batches):
        only(None)
        for batch in batches:
            n, low, high, kept = [], [], [], []
            with np.errstate(over="ignore"):
                for s in (x for _, _, texts in parts(batch, STEP) for x in sets_of(texts)):
                    n.append(len(s))
                    low.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    high.append(int(mix(s + np.uint64(0x9E37)).sum(dtype=np.uint64).view(np.int64)))
                    kept.append(s[:RETAINED].view(np.int64).copy())
            offsets = pa.array(np.cumsum([0, *map(len, kept)]), pa.int32())
            values = pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "text_hash", "n_shingles", "low", "high", "sketch"])

    rows = text_rows(docs, id_col, text_col).withColumns({"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64("text")})
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, low long, high long, sketch array<long>")


def index(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``value, node, n, shared``: inverted lists in which any two linked nodes meet.

    Two linked classes share ``SHARED`` of their ``INDEXED`` smallest values (a
    like part of a smaller sketch), so one of these is among the rarest
    ``INDEXED - SHARED + 1`` of either.  Only those are listed: values that no
    other class has come first and need no list, very frequent ones come last.  ``shared``
    is how many of a node's indexed values others have.  Also, per list of more
    than one node, ``value, often, head, words``: its length, words and the node
    that shares the most, which in a group of copies is the one they come from.
    """
    size = F.least(F.size("sketch"), F.lit(INDEXED))
    listed = classes.select("node", F.col("n_shingles").alias("n"), size.alias("size"), F.explode(F.slice("sketch", 1, INDEXED)).alias("value"))
    often = cut(listed.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    known = often.withColumn("often_", F.col("often"))
    found = F.sort_array(F.collect_list(F.struct("often_", "value"))).alias("found")  # at most INDEXED
    by_class = join_sized(listed, known, ["value"], "often").groupBy("node", "n", "size").agg(found)
    must = F.greatest(F.lit(1), F.floor(F.col("size") * (SHARED / INDEXED)).cast("int"))
    quota = F.size("found") - must + 1  # the rarest size - must + 1 without those of no other class
    lists = cut(by_class.withColumn("quota", quota).where("quota > 0").select(F.explode(F.slice("found", 1, F.col("quota"))).alias("x"), "node", "n", F.size("found").alias("shared")).select("x.value", "node", "n", "shared"))
    heads = lists.groupBy("value").agg(F.count(F.lit(1)).alias("often"), F.max(F.struct("shared", F.negative("node").alias("before"), "node", "n")).alias("head"), F.sum("n").alias("words")).where("often > 1")
    return lists, cut(heads)


def near_sizes(a: str = "n_a", b: str = "n_b"):
    """Sets of too different a size cannot be similar enough."""
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def compare(pairs: DataFrame, payload: DataFrame, alike) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose payloads are ``alike(list of a, list of b)``.

    ``payload`` has ``node`` and ``data``.  Partners of one document are dealt
    to groups of about ``GROUP``, fewer where their texts are long; each gets
    that document's payload.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"), F.sum("n_b").alias("words"))
    groups = F.greatest(F.ceil(F.col("partners") / GROUP), F.ceil(F.col("words") * WORD / BLOCK))
    salted = join_sized(pairs, cut(counts.withColumn("groups", groups).select("a", "partners", "groups")), ["a"], "partners")
    salted = cut(salted.select("a", "b", "n_a", "n_b", F.pmod(F.xxhash64("b"), "groups").alias("salt")))
    others = salted.select("a", "salt", F.col("b").alias("node"), "n_a", "n_b").join(payload, "node")
    own = salted.select("a", "salt").distinct().join(payload, F.col("a") == F.col("node"))
    columns = ["a", "salt", "node", "data", "n_a", "n_b"]

    def run(table):
        held = {b: (d, x, y) for b, d, x, y in zip(*(table[c].to_pylist() for c in columns[2:]), strict=True)}  # repeated rows once
        a = table["a"][0].as_py()
        own = held.pop(a)[0]
        found = [(b, x, y) for (b, (_, x, y)), good in zip(held.items(), alike(own, [d for d, _, _ in held.values()]), strict=True) if good]
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), **{c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate(("b", "n_a", "n_b"))}})

    both = others.select(*columns).unionByName(own.select("a", "salt", "node", "data"), allowMissingColumns=True)
    return both.groupBy("a", "salt").applyInArrow(run, "a long, b long, n_a long, n_b long")


def estimates(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the bottom-k sketch of each union lets the pair be similar enough.

    A row of ``others`` is a sketch, filled up with the largest number.
    """
    full = np.iinfo(np.uint64).max
    both = np.sort(np.concatenate([np.broadcast_to(mine, (len(others), len(mine))), others], axis=1), axis=1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != full)
    sizes = (others != full).sum(axis=1)
    union = (mine != full).sum() + sizes - twice.sum(axis=1)
    complete = np.maximum(sizes, (mine != full).sum()) < RETAINED
    k = np.where(complete, union, np.minimum(union, RETAINED))
    rank = np.arange(1, twice.shape[1] + 1) - np.cumsum(twice, axis=1) + 1  # among different values
    return (twice & (rank <= k[:, None])).sum(axis=1) >= ESTIMATE * k


def filled(sketches: list) -> np.ndarray:
    """Sketches as the rows of a matrix."""
    out = np.full((len(sketches), RETAINED), np.iinfo(np.uint64).max)
    for row, s in zip(out, sketches, strict=True):
        row[: len(s)] = np.asarray(s).view(np.uint64)
    return out


def estimated(own: list[int], others: list[list[int]]) -> list[bool]:
    mine, *rest = filled([np.array(s, np.int64) for s in (own, *others)])
    return estimates(mine, np.array(rest).reshape(-1, RETAINED)).tolist()


def similar(own: bytes, others: list[bytes]) -> list[bool]:
    """Exact Jaccard similarity of the full sets, at least 0.75."""
    unpack = zstandard.ZstdDecompressor().decompress
    mine, *rest = sets_of([unpack(t) for t in (own, *others)])
    out = []
    for s in rest:
        both = np.concatenate([mine, s])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        out.append(100 * common >= 75 * (len(both) - common))
    return out


def packed_texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, data``: the packed text that stands for each node (``doc_id`` and ``text_hash``)."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [packer.compress(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(data, pa.binary())], ["node", "data"])

    texts = text_rows(docs, id_col, text_col).where("text IS NOT NULL").withColumns({"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64("text")})
    return texts.join(nodes, ["doc_id", "text_hash"]).select("node", "text").mapInArrow(run, "node long, data binary")


def star_pairs(lists: DataFrame, heads: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b``: each node of a list with the list's head."""
    pairs = join_sized(lists, heads.select("value", "often", "head"), ["value"], "often").where(F.col("node") != F.col("head.node"))
    pairs = pairs.select(F.col("head.node").alias("a"), F.col("node").alias("b"), F.col("head.n").alias("n_a"), F.col("n").alias("n_b"))
    return pairs.where(near_sizes()).distinct()


def apart(lists: DataFrame, heads: DataFrame, label: DataFrame) -> DataFrame:
    """``value, node, n, component, often, words`` of the lists that hold more than one component."""
    labelled = cut(lists.join(label, "node", "left").select("value", "node", "n", F.coalesce("component", "node").alias("component")))
    mixed = labelled.groupBy("value").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    mixed = mixed.join(heads.select("value", "often", "words"), "value").where("often > 2")  # of two the star has seen all
    return cut(join_sized(labelled, cut(mixed.select("value", "often", F.col("often").alias("size"), "words")), ["value"], "size"))


def listed_pairs(lists: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b`` of all lists of at most ``CROWD`` nodes that are not joined yet."""
    short = lists.where(F.col("often") <= CROWD)
    left = short.select("value", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("own"))
    right = short.select("value", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("other"))
    return left.join(right, "value").where((F.col("a") < F.col("b")) & (F.col("own") != F.col("other")) & near_sizes()).select("a", "b", "n_a", "n_b").distinct()


def forest(sets: list[np.ndarray], first: np.ndarray, sketch: np.ndarray, label: np.ndarray, smaller: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all sets which any links between them join, as places.

    ``first`` parts the sets in two; if both parts have some, only links from
    one to the other are looked for.  Sets with one ``label`` are joined already,
    and those with a common value in ``smaller`` meet in that value's list.
    One set at a time is held against all others that are not yet joined to it:
    sketches first, then the set itself is marked and counted in the others.
    """
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    _, label = np.unique(label, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark, out = np.zeros(int(ids.max()) + 1, bool), []
    elsewhere = np.full((len(sets), max(1, *map(len, smaller))), np.iinfo(np.int64).max)
    for row, values in zip(elsewhere, smaller, strict=True):
        row[: len(values)] = values
    two = first.any() and not first.all()
    for a in np.flatnonzero(first).tolist() if two else range(len(sets)):
        near = (100 * np.minimum(sizes, sizes[a]) >= 75 * np.maximum(sizes, sizes[a])) & (label != label[a])
        near &= ~first if two else np.arange(len(sets)) > a
        others = np.flatnonzero(near)
        if len(smaller[a]):
            at = np.minimum(np.searchsorted(smaller[a], elsewhere[others]), len(smaller[a]) - 1)
            others = others[~(smaller[a][at] == elsewhere[others]).any(axis=1)]
        others = others[estimates(sketch[a], sketch[others])]
        if not len(others):
            continue
        n = sizes[others]
        cuts = np.cumsum(n) - n
        places = np.arange(int(n.sum())) + np.repeat(starts[others] - cuts, n)
        mark[ids[starts[a] : starts[a] + sizes[a]]] = True
        common = np.add.reduceat(mark[ids[places]], cuts, dtype=np.int64)
        mark[ids[starts[a] : starts[a] + sizes[a]]] = False
        for b in others[100 * common >= 75 * (sizes[a] + n - common)].tolist():
            if label[b] != label[a]:
                label[label == label[b]] = label[a]
                out.append((a, b))
    return out


def crowd_links(lists: DataFrame, payload: DataFrame) -> DataFrame:
    """``a, b``: links that join what any links within a list of more than ``CROWD`` nodes join.

    A list's nodes are dealt to parts of about ``PART``, fewer where their texts are long; every two parts
    meet in one task, which looks at all nodes that are not joined yet; two
    nodes that share several lists are held against each other in one of them.
    """
    parts = F.greatest(F.ceil(F.col("words") * WORD / BLOCK), F.ceil(F.col("often") / PART))
    part = F.pmod(F.xxhash64("node"), parts)
    dealt = lists.where(F.col("often") > CROWD).select("value", "node", "component", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    sent = dealt.select("value", "node", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).join(payload, "node")
    sent = sent.withColumn("smaller", F.sort_array(F.filter("listed", lambda v: v < F.col("value")))).drop("listed")

    def run(table):
        columns = (table[c].to_pylist() for c in ("node", "part", "component", "data", "smaller"))
        held = {n: rest for n, *rest in zip(*columns, strict=True)}
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        nodes, unpack = sorted(held), zstandard.ZstdDecompressor().decompress
        first, label = np.array([held[n][0] == i for n in nodes]), np.array([held[n][1] for n in nodes])
        found = []
        if (i == j or (first.any() and not first.all())) and (label != label[0]).any():
            sets = list(sets_of([unpack(held[n][2]) for n in nodes]))
            found = forest(sets, first, filled([x[:RETAINED] for x in sets]), label, [np.array(held[n][3], np.int64) for n in nodes])
        return pa.table({"a": pa.array([nodes[x] for x, _ in found], pa.int64()), "b": pa.array([nodes[y] for _, y in found], pa.int64())})

    return sent.groupBy("value", "i", "j").applyInArrow(run, "a long, b long")


def links(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``a, b``: verified links between classes that connect all that are linked.

    No two nodes of a list are left out but those whose sizes or estimate rule
    them out and those that other links join already.
    """
    lists, heads = index(classes)
    wanted = classes.join(lists.select("node").distinct(), "node")
    texts = cut(packed_texts(docs, wanted.select("node", "rep.*"), id_col, text_col))
    sketch = classes.select("node", F.col("sketch").alias("data"))
    release(docs.sparkSession)

    def verified(pairs):
        maybe = cut(compare(cut(pairs), sketch, estimated))
        release(docs.sparkSession)
        return compare(maybe, texts, similar).select("a", "b")

    stars = cut(verified(star_pairs(lists, heads)))
    left = apart(lists, heads, components(stars, rounds=2))  # labels only save comparisons
    release(docs.sparkSession)
    short = cut(verified(listed_pairs(left)))
    release(docs.sparkSession)
    crowded = left.where(F.col("often") > CROWD).groupBy("node").agg(F.collect_list("value").alias("listed"))  # INDEXED values at most
    long_ = cut(crowd_links(left, texts.join(crowded, "node")))
    return stars.unionByName(short).unionByName(long_)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` per row of ``docs``.

    Two documents are linked if 100 times the size of the intersection of
    their sets of 5-word shingles is at least 75 times that of the union;
    ``component_id`` is the smallest id that links reach, ``kept`` whether that
    is the document's own.  A link between large sets of similarity 0.75
    is missed with a chance below 1e-12, between more similar ones with less.

    Words are lower-cased (A to Z) and split at space and 0x09 to 0x0D.  With
    fewer than five words the whole sequence is the one shingle; null texts and
    texts without words have none and are linked with nothing.  Rows that
    repeat an id are looked at on their own and share the id's fate as a
    component; a null id takes the component of equal texts, else null.  Extra columns are
    ignored; an empty table gives no rows.
    """
    rows = cut(sketches(docs, id_col, text_col))
    same = ["low", "high", "n_shingles"]
    rep = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("rep")
    held = rows.where("n_shingles > 0").groupBy(*same).agg(rep, F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    classes = cut(held.where("rep IS NOT NULL").withColumn("node", F.monotonically_increasing_id()))
    found = links(classes, docs, id_col, text_col)
    label = cut(components(found).join(classes.select("node", F.col("rep.doc_id").alias("doc_id")), "node"))
    least = cut(label.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")))
    linked = join_sized(label, least, ["component"], "size").select("node", "component_id")
    named = cut(classes.join(linked, "node", "left").select(*same, "copies", F.coalesce("component_id", "rep.doc_id").alias("component_id")))
    out = rows.select("doc_id", "text_hash", *same)
    own = out.where("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long"))  # these are linked with nothing
    out = join_sized(out.where("n_shingles > 0"), named, same, "copies", "left").unionByName(own)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``near_dedup`` keeps.

    Null texts, texts without words and rows with a null id whose text no other
    row holds stay; rows that repeat an id and a text fare alike, and those of
    the smallest id stay all.  Columns may have any names.  An empty table
    gives no rows.
    """
    own, hashed = unused(docs.columns, "id", "hash")
    gone = near_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).distinct()
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own)) & F.xxhash64(F.col(f"`{text_col}`").cast("binary")).eqNullSafe(F.col(hashed))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")
