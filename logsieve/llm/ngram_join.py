"""N-gram Jaccard join: near-duplicate documents by a MinHash LSH forest.

Words are lower-cased runs of letters, digits and underscores; a shingle is WORDS consecutive
words (a shorter text is one shingle).  Two documents are linked when the Jaccard similarity of
their shingle sets is THRESHOLD or more; classes are the connected components of the links.

1. Every document gets its shingle set's fingerprint (128 bits) and a label of DEPTH MinHash letters, a byte
   each, for each of TREES trees.  Documents with equal sets become one content with a multiplicity.
2. Forest: the contents, sorted by a tree's labels, are its prefix trie.  Tasks get whole branches below the
   shortest prefix that may be needed, and walk them from the longest prefix up: contents that share
   DEPTH letters meet first, and a branch whose contents are connected already is finished there.  Only a
   branch that still falls apart has its prefix shortened, letter by letter, down to the length at which
   all trees together reach RECALL for pairs at THRESHOLD.  Contents that meet are joined when
   their whole signatures agree in enough letters; what this gate misses (less than a thousandth of what
   the recall allows) is counted in the recall.  A branch sends one edge per member, no pairs.
3. Connected components of these edges are candidate groups.  Their texts come together, and
   all shingle sets of a group are compared exactly, by counting common shingles.
4. Links are counted with the partners' multiplicities; components of the verified links are
   the classes, named by their smallest doc_id.

Branches and groups of more than BLOCK members are first compared with one member, their pivot.  In a branch,
members that agree with the pivot are connected by it.  In a group, members within half of the allowed distance
of the pivot are linked with each other, as the Jaccard distance is a metric; they are counted, not compared.
Only the far members meet all others: they are cut into blocks, and pairs of blocks that hold far members become
tasks of their own, so no task holds more than about two blocks, and near members are copied once per
block of far ones.  A group of a million copies of nearly one text costs a million comparisons.

Defined results: null or empty text, or text without a word, has no shingle and no link; the
identifier may be null or repeated (rows are counted by themselves; a class of null identifiers
has a null name); documents without a link form a class of their own; equal texts
are links; an empty table gives no rows; other columns are not read.  A shingle is told apart by
64 bits of its words' hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.common import chunks, cut, map_batches, table
from logsieve.llm.components import connected_components
from logsieve.llm.spans import Spans, mixed

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 18, 8
LETTERS = TREES * DEPTH
RECALL = 0.999
BLOCK = 512
#: Members of candidate groups that a task compares, about.
TASK_MEMBERS = 2000

BASE = np.uint64(0x9E3779B97F4A7C15)


def gate_misses(threshold: float, agree: int) -> float:
    """The probability that the signatures of a pair at the threshold agree in fewer letters."""
    return sum(math.comb(LETTERS, k) * threshold**k * (1 - threshold) ** (LETTERS - k) for k in range(agree))


def agreement(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The most letters whose misses take a thousandth of what the recall allows."""
    agree = 0
    while gate_misses(threshold, agree + 1) <= (1 - recall) / 1000:
        agree += 1
    return agree


def least_recall(threshold: float, trees: int, depth: int, agree: int) -> float:
    """Of pairs at the threshold: the forest's misses and the gate's misses add up at most."""
    return 1 - (1 - threshold**depth) ** trees - gate_misses(threshold, agree)


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Where shortening ends: the longest prefix, `depth` letters at most, with which the trees reach the recall."""
    agree = agreement(threshold, recall)
    while depth > 1 and least_recall(threshold, trees, depth, agree) < recall:
        depth -= 1
    return depth


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int = WORDS):
        self.words, self.spans = words, Spans(lambda c: int(c.isalnum() or c == "_"))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        starts, ends, _ = self.spans.find([t.lower() for t in texts])
        h, bounds = self.spans.hashes(starts, ends), self.spans.text_bounds(starts)
        sizes = np.diff(bounds)
        # windows of all texts at once; those that reach into the next text are left out below
        n = self.words
        total = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for j in range(n):
            total = total * BASE + h[j:j + len(total)]
        total = mixed(total)
        out = []
        for a, size in zip(bounds.tolist(), sizes.tolist()):
            if size >= n:
                out.append(np.unique(total[a:a + size - n + 1]))
            elif size:
                short = np.full(1, size, np.uint64)
                for x in h[a:a + size]:
                    short = short * BASE + x
                out.append(mixed(short))
            else:
                out.append(h[:0])
        return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int] | None:
    """128 bits for the set, None for an empty one."""
    import xxhash
    if not len(shingles):
        return None
    whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (whole >> 64) - 2**63, (whole & (2**64 - 1)) - 2**63


def signature_of(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash letters: for each factor the smallest product, a byte of its mixed bits."""
    least = np.full(len(factors), np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i:i + 512, None] * factors).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(56)).astype(np.uint8)


def labels_of() -> list[str]:
    return [f"t{i}" for i in range(TREES)]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, hi, lo (the set's fingerprint, null without shingles), t0.. (each tree's label, the first
    letter uppermost)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = labels_of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        draw = np.random.default_rng(23)
        factors = draw.integers(1, 2**63, LETTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                sets = shingler.sets(texts[a:b])
                letters = np.array([signature_of(s, factors) for s in sets]).reshape(len(sets), LETTERS)
                labels = letters.view(">u8").astype(np.uint64).view(np.int64)
                marks = [fingerprint(s) for s in sets]
                cols = [pa.array([None if m is None else m[k] for m in marks], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 2)), *cols,
                                                  *[pa.array(c) for c in labels.T]], ["doc_id", "text_key", "hi", "lo", *names])

    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return map_batches(keyed, run, f"doc_id {kind}, text_key long, hi long, lo long, " + ", ".join(f"{c} long" for c in names))


def groups_in(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of consecutive rows with equal keys; several groups at a time."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        same = np.ones(t.num_rows, bool)
        for k in keys:
            column = t[k].to_numpy()
            same &= column == column[-1]
        whole = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = t.slice(whole)
        if whole:
            yield t.slice(0, whole)
    if rest is not None and rest.num_rows:
        yield rest


def starts_of(t: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups, and the number of rows at the end."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        c = t[k].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def in_blocks(df: DataFrame, node: str) -> DataFrame:
    """Deal the members of groups to blocks: adds own (the row's block), lo, hi (the pair of blocks that meet).
    `df` has n and n_far, the members and the far members of the row's group, and far.  Far members have blocks
    0, 1, ... and meet all blocks; the blocks of the others follow and meet those of the far ones only."""
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    df = df.withColumn("_far", blocks(F.col("n_far"))).withColumn("_near", blocks(F.col("n") - F.col("n_far")))
    place = lambda n: F.pmod(F.xxhash64(node, F.lit("block")), F.greatest(F.col(n), F.lit(1))).cast("int")
    df = df.withColumn("own", F.when(F.col("far"), place("_far")).otherwise(F.col("_far") + place("_near")))
    met = F.when(F.col("far"), F.sequence(F.lit(0), F.greatest(F.col("_far") + F.col("_near") - 1, F.lit(0)))).when(
        F.col("_far") > 0, F.sequence(F.lit(0), F.greatest(F.col("_far") - 1, F.lit(0))))
    df = df.withColumn("other", F.explode(met))
    return (df.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
            .drop("other", "n", "n_far", "far", "_far", "_near"))


def climb(group: np.ndarray, label: np.ndarray, alike, longest: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Walk branches of a trie from the longest prefix up.  Rows are sorted by `group` (a branch below the shortest
    prefix) and `label` (unsigned, the first letter uppermost); alike(i, j) tells which pairs of rows to join.
    Returns for every row the smallest row it is connected with, and the prefix length at which its branch
    was finished: all connected, or `shortest`."""
    n = len(label)
    root, ended = np.arange(n), np.full(n, shortest)
    left, right = [], []
    open_ = np.ones(n, bool)
    for length in range(longest, shortest - 1, -1):
        prefix = label >> np.uint64(8 * (DEPTH - length))
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        p, g = prefix[rows], group[rows]
        new = np.append(True, (p[1:] != p[:-1]) | (g[1:] != g[:-1]))
        node = np.cumsum(new) - 1
        most = int(np.bincount(node).max())
        for step in range(1, most):
            at = np.flatnonzero(node[step:] == node[:-step])
            i, j = rows[at], rows[at + step]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            if len(i):
                good = alike(i, j)
                left.append(i[good])
                right.append(j[good])
        if left:
            root = least_labels(n, np.concatenate(left), np.concatenate(right))
        # a branch is finished when all of its contents are connected
        least, greatest = np.full(group[-1] + 1, n), np.full(group[-1] + 1, -1)
        np.minimum.at(least, group, root)
        np.maximum.at(greatest, group, root)
        still = (least < greatest)[group]
        ended[open_ & ~still] = length
        open_ &= still
    return root, ended


def candidate_edges(contents: DataFrame, shortest: int, agree: int) -> DataFrame:
    """a, b: edges that connect the contents of a branch whose signatures agree."""
    names = labels_of()
    trees = F.array(*[F.struct(F.lit(i).alias("tree"), F.col(c).alias("label")) for i, c in enumerate(names)])
    rows = cut(contents.select("content", F.inline(trees))
               .withColumn("branch", F.shiftrightunsigned("label", 8 * (DEPTH - shortest))))
    shared = rows.groupBy("tree", "branch").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = rows.join(cut(shared), ["tree", "branch"]).join(contents.select("content", *names), "content")
    node = ["tree", "branch"]
    large = members.filter(F.col("n") > BLOCK)
    pivots = large.groupBy(*node).agg(F.min(F.struct("content", *names)).alias("pivot"))
    paired = large.join(pivots, node).select(*node, "n", "content", "label", *names, F.col("pivot.content").alias("pivot"),
                                             *[F.col(f"pivot.{c}").alias(f"p{c}") for c in names])

    def with_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in [*node, "n", "content", "label", *names, "pivot"]]
            grid = lambda prefix: np.ascontiguousarray(np.column_stack(
                [batch.column(prefix + c).to_numpy() for c in names])).view(np.uint8)  # noqa: B023
            agreeing = (grid("") == grid("p")).sum(axis=1) >= agree
            yield pa.RecordBatch.from_arrays([*columns, pa.array(~agreeing)], [*node, "n", "content", "label", *names, "pivot", "far"])

    kinds = {f.name: f.dataType.simpleString() for f in paired.schema}
    layout = [*node, "n", "content", "label", *names, "pivot"]
    judged = cut(map_batches(paired, with_pivot, ", ".join(f"{c} {kinds[c]}" for c in layout) + ", far boolean"))
    starred = judged.filter(~F.col("far") & (F.col("content") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("content").alias("b"))
    far = judged.groupBy(*node).agg(F.count_if("far").alias("n_far")).filter("n_far > 0")
    rest = judged.drop("pivot").join(far, node)
    small = members.filter(F.col("n") <= BLOCK).withColumn("far", F.lit(True)).withColumn("n_far", F.col("n"))
    keys = ["tree", "branch", "lo", "hi"]
    # the label as an unsigned number: its sign bit turned for the sort
    meeting = small.unionByName(rest).withColumn("place", F.col("label").bitwiseXOR(F.lit(-2**63)))
    dealt = in_blocks(meeting, "content").repartition(*keys).sortWithinPartitions(*keys, "place", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_in(batches, keys):
            starts = starts_of(t, keys)
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            cross, own = t["lo"].to_numpy() != t["hi"].to_numpy(), t["own"].to_numpy()
            letters = np.ascontiguousarray(np.column_stack([t[c].to_numpy() for c in names])).view(np.uint8)

            def alike(i, j):
                # two different blocks meet here only to be compared with one another
                good = ~cross[i] | (own[i] != own[j])
                at = np.flatnonzero(good)
                for k in range(0, len(at), 100_000):
                    part = at[k:k + 100_000]
                    good[part] = (letters[i[part]] == letters[j[part]]).sum(axis=1) >= agree
                return good

            root, _ = climb(group, t["label"].to_numpy().view(np.uint64), alike, DEPTH, shortest)
            content = t["content"].to_numpy()
            # to the smallest content, which is the same one in most trees: so the trees' edges are mostly equal
            least = content.copy()
            np.minimum.at(least, root, content)
            at = np.flatnonzero(least[root] != content)
            yield pa.RecordBatch.from_arrays([pa.array(least[root[at]]), pa.array(content[at])], ["a", "b"])

    return map_batches(dealt, run, "a long, b long").unionByName(starred).distinct()


def common_shingles(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first `left` sets with the others (with all sets if
    `left` is their number; a set's count with itself is then not meant)."""
    sizes = [len(s) for s in sets]
    flat = np.concatenate(sets)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    several = times[number] > 1
    _, number = np.unique(number[several], return_inverse=True)
    row = row[several]
    first = 0 if left == len(sets) else left
    out = np.zeros((left, len(sets) - first), np.int64)
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    width = max(256, 4_000_000 // len(sets))
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [at, at + width])
        held = np.zeros((len(sets), width), np.float32)
        held[row[a:b], number[a:b] - at] = 1
        out += np.rint(held[:left] @ held[first:].T).astype(np.int64)
    return out


def verified(grouped: DataFrame, docs: DataFrame, words: int, threshold: float, tasks: int) -> DataFrame:
    """a, b, n: content a gains n links here and is connected with b.  `grouped`: content, hi, lo, rep (the row that has
    the text: none, doc_id, text_key, times), copies, root, n (contents of the candidate group)."""
    keys = ["root", "lo", "hi"]
    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumnRenamed("doc_id", "rep_id")
    named = grouped.withColumnRenamed("hi", "mark_hi").withColumnRenamed("lo", "mark_lo")
    # written, as several branches follow: the documents are exchanged once
    texts = cut(keyed.join(named, F.col("rep_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_key") == F.col("rep.text_key"))))
    # rows that repeat the identifier and the text stand for one content
    texts = texts.filter("rep.times = 1").unionByName(texts.filter("rep.times > 1").dropDuplicates(["content"]))
    texts = texts.drop("rep", "rep_id", "text_key")
    large = texts.filter(F.col("n") > BLOCK)
    pivots = large.filter("content = root").select("root", F.col("text").alias("pivot_text"))

    def near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            both = [[x or "" for x in batch.column(c).to_pylist()] for c in ("text", "pivot_text")]
            out = []
            known: dict[str, np.ndarray] = {}
            for a, b in chunks(both[0]):
                own = shingler.sets(both[0][a:b])
                new = list(set(both[1][a:b]) - known.keys())
                known.update(zip(new, shingler.sets(new), strict=True))
                for x, pivot in zip(own, both[1][a:b], strict=True):
                    common = len(np.intersect1d(x, known[pivot], assume_unique=True))
                    # half of the distance allowed, and no rounding in favour of it
                    out.append(2 * common < (1 + threshold) * (len(x) + len(known[pivot]) - common) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("content"), batch.column("copies"),
                                              pa.array(out, pa.bool_())], ["root", "content", "copies", "far"])

    flags = cut(map_batches(large.join(pivots, "root").select("root", "content", "copies", "text", "pivot_text"), near_pivot,
                            "root long, content long, copies long, far boolean"))
    sides = flags.groupBy("root").agg(F.count_if("far").alias("n_far"), F.sum(F.when(~F.col("far"), F.col("copies"))).alias("near"))
    counted = (flags.filter(~F.col("far")).join(sides, "root")
               .select(F.col("content").alias("a"), F.col("root").alias("b"), (F.col("near") - F.col("copies")).alias("n")).filter("n > 0"))
    rest = large.join(flags.select("root", "content", "far"), ["root", "content"]).join(sides.select("root", "n_far"), "root")
    small = texts.filter(F.col("n") <= BLOCK).withColumn("far", F.lit(True)).withColumn("n_far", F.col("n"))
    dealt = (in_blocks(small.unionByName(rest), "content").repartition(tasks, *keys)
             .sortWithinPartitions(*keys, "own", "content"))

    def compare(t: pa.Table, sets: list[np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        content, copies, own = t["content"].to_numpy(), t["copies"].to_numpy(), t["own"].to_numpy()
        inside = t["lo"][0].as_py() == t["hi"][0].as_py()
        left = len(sets) if inside else int((own == own[0]).sum())
        if not inside and left == len(sets):
            return []
        first = 0 if inside else left
        sizes = np.array([len(s) for s in sets])
        both = common_shingles(sets, left)
        alike = both >= threshold * (sizes[:left, None] + sizes[None, first:] - both) - 1e-9
        if inside:
            np.fill_diagonal(alike, False)
        i, j = np.nonzero(alike)
        label = least_labels(len(sets), i, j + first)
        links = np.zeros(len(sets), np.int64)
        links[:left] += alike @ copies[first:]
        if not inside:
            links[left:] += alike.T @ copies[:left]
        at = np.flatnonzero(links)
        return [(content[at], content[label[at]], links[at])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for t in groups_in(batches, keys):
            starts = starts_of(t, keys)
            texts = [x or "" for x in t["text"].to_pylist()]
            sets = [x for a, b in chunks(texts) for x in shingler.sets(texts[a:b])]
            marks = list(zip(t["mark_hi"].to_pylist(), t["mark_lo"].to_pylist(), strict=True))
            content = t["content"].to_pylist()
            out = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                # should one identifier have several texts of one hash, each content counts once
                place: dict[int, int] = {}
                for k in range(a, b):
                    if fingerprint(sets[k]) == marks[k]:
                        place.setdefault(content[k], k)
                keep = sorted(place.values())
                if len(keep) > 1:
                    out += compare(t.take(pa.array(keep)), [sets[k] for k in keep])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "n"])

    return map_batches(dealt, run, "a long, b long, n long").unionByName(counted)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS,
                    recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_key, hi, lo; classes: hi, lo, class_content, class_id, copies, n_links)."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names, mark = labels_of(), ["hi", "lo"]
    signed = cut(signatures(slim, words))
    same = (signed.filter("hi IS NOT NULL").groupBy(*mark, "doc_id", "text_key")
            .agg(F.count(F.lit(1)).alias("times"), *[F.min(c).alias(c) for c in names]))
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "times")
    contents = cut(same.groupBy(*mark).agg(F.min("doc_id").alias("name"), F.min(rep).alias("rep"), F.sum("times").alias("copies"),
                                           *[F.min(c).alias(c) for c in names])
                   .withColumn("content", F.monotonically_increasing_id()))      # numbered where it is written
    edges = candidate_edges(contents, prefix_length(threshold, recall=recall), agreement(threshold, recall))
    groups = connected_components(edges)
    sizes = cut(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    members = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(members) // TASK_MEMBERS))
    grouped = (groups.join(sizes, "root").withColumnRenamed("node", "content")
               .join(contents.select("content", *mark, "rep", "copies"), "content"))
    links = cut(verified(grouped, slim, words, threshold, tasks))
    classes = connected_components(links.select("a", "b"))
    partners = links.groupBy("a").agg(F.sum("n").alias("partners"))
    linked = (contents.select("content", *mark, "name", "copies")
              .join(partners.withColumnRenamed("a", "content"), "content", "left")
              .join(classes.withColumnRenamed("node", "content"), "content", "left")
              .withColumn("root", F.coalesce("root", "content")))
    of_class = linked.groupBy("root").agg(F.min("name").alias("class_id"))
    out = cut(linked.join(of_class, "root").select(
        *mark, F.col("root").alias("class_content"), "class_id", "copies",
        (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")))
    return signed.select("doc_id", "text_key", *mark), out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input with one document of each class: that of the smallest identifier (of the
    smallest text hash, should several texts have it).  Rows with equal identifier and text are
    one document: they stay or go together."""
    rows, classes = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    members = cut(rows.join(classes.select("hi", "lo", "class_content"), ["hi", "lo"]).drop("hi", "lo"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = (members.groupBy("class_content").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1"))
    gone = (members.join(best, "class_content").filter(order != F.col("best"))
            .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    key = F.xxhash64(F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")))
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["__id"]) & (key == gone["__key"]), "left_anti")


def ngram_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_links of every row."""
    rows, classes = near_duplicates(docs, **options)
    joined = rows.join(classes.select("hi", "lo", "class_id", "n_links"), ["hi", "lo"], "left")
    alone = F.col("hi").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                         F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
