"""Near-duplicate components by an n-gram Jaccard join with adaptive prefixes.

Exact, in steps that each leave less to do:

1. Documents with equal shingle sets are one (their smallest doc_id stands for
   them).
2. A shingle that no other document has cannot be shared. One shuffle of packed
   hash blocks counts how many of a document's shingles occur elsewhere; with too
   few of them no partner can exist. Most documents end here.
3. Shingles of the rest are ordered by their exact document frequency. Two
   linked documents share at least l shingles of their l-prefixes, which are
   longer by l - 1 than usual. Each document takes the l of least estimated cost:
   list entries read, plus candidates, which l shared shingles make fewer.
4. Every prefix shingle offers its least private document as a hub; documents
   verified against hubs form components. Only pairs across components are then
   joined, block by block of a token's documents, counted against the smaller l, and
   verified on the words themselves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm import packed
from dispatchlake.llm.common import small_batches
from dispatchlake.llm.window_dedup import first_hashes
from dispatchlake.session import stage

WORDS = 3
PERCENT = 90
MOST_LEVELS = 6
VERIFY_COST = 20.0
# documents of a prefix token that meet in one block
TOKEN_BLOCK = 512
# counters of the sketch that bounds an overlap
SKETCH = 128


def lower_words(text: str | None) -> list[bytes]:
    """`byte_words` with A-Z in lower case; other letters stay (`bytes.lower` is ASCII only)."""
    return text.encode().lower().split() if isinstance(text, str) else []


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all n-word shingles; a shorter text is one."""
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < n:
        return np.unique(first_hashes([*words, b"\x00 short"], len(words) + 1))
    return np.unique(first_hashes(words, n))


def shingle_set(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for verification."""
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n)), strict=False))


def needed(n: int, percent: int) -> int:
    """Smallest overlap that a set of n shingles can have with a linked one."""
    return -(-percent * n // 100)


def sizes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest of the shingle set, null for an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                own = shingles(lower_words(text), words)
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest()
                known = None if pd.isna(doc_id) else int(doc_id)
                out.append((known, len(own), digest if len(own) else None))
            names = ["doc_id", "n_shingles", "digest"]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, "doc_id long, n_shingles long, digest string")


def seen_twice(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Entries whose hash occurs again."""
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(hashes), bool)
    return twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes


def shared_counts(docs: DataFrame, words: int, total: int) -> DataFrame:
    """Per doc_id, how many of its shingles some other row has too.

    Hashes travel in packed blocks, four bytes each and the rest implied by the
    block. Two different shingles may meet in what is left; a document then only
    seems to share more, and a later step finds out.
    """
    blocks = packed.n_blocks(total)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, sets, n, number = [], [], 0, 0

        def send(batch: int, own: np.ndarray, hashes: np.ndarray) -> pd.DataFrame:
            block = ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)).astype(np.int64)
            high = (hashes >> np.uint64(32)).astype("<u4")
            return packed.rows_by_block(batch, own, block, high, blocks)

        def rows() -> Iterator[pd.DataFrame]:
            key = packed.batch_key(number)
            hashes = np.concatenate(sets).view(np.uint64)
            own = np.repeat(np.array(ids, np.int64), [len(s) for s in sets])
            again = seen_twice(own, hashes)
            yield send(key, own[~again], hashes[~again])
            if again.any():
                # known here already: the documents get their marks, and one entry per
                # hash tells other batches, so a common shingle costs a row per batch
                docs, counts, _ = packed.by_doc(own[again], hashes[again])
                done = [(key % blocks, key, docs, counts, b"", True)]
                yield pd.DataFrame(done, columns=packed.NAMES)
                common = np.unique(hashes[again])
                yield send(packed.WITNESS, np.zeros(len(common), np.int64), common)

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                own = shingles(lower_words(text), words)
                if not len(own):
                    continue
                ids.append(int(doc_id))
                sets.append(own)
                n += len(own)
                if n >= packed.MAP_HASHES:
                    yield from rows()
                    ids, sets, n, number = [], [], 0, number + 1
        if ids:
            yield from rows()

    sent = docs.where("doc_id is not null").mapInPandas(pack, packed.ROW)
    counted = packed.marked(sent, blocks, 4, seen_twice, send_hashes=False)
    return counted.groupBy("doc_id").agg(F.sum("n").alias("shared"))


def possible(percent: int, x: str, y: str) -> Column:
    """Whether two documents, given by column prefixes, can be linked.

    They have n shingles, u of them private. The rest is counted by 128 hash
    classes; no class can share more than the smaller of its two counts. The
    counts are compared only where the totals leave the question open.
    """
    n, m = F.col(f"{x}n"), F.col(f"{y}n")

    def enough(most: Column) -> Column:
        return F.lit(100) * most >= F.lit(percent) * (n + m - most)

    total = F.least(n - F.col(f"{x}u"), m - F.col(f"{y}u"))
    least = F.zip_with(f"{x}sketch", f"{y}sketch", lambda a, b: F.least(a, b))
    common = F.aggregate(least, F.lit(0), lambda s, k: s + k)
    return enough(total) & enough(common)


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike enough, compared word by word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @functools.lru_cache(maxsize=4)
        def of(text: str) -> set:
            return shingle_set(lower_words(text), words)

        for frame in frames:
            keep = []
            for left, right in zip(frame["left"], frame["right"], strict=True):
                x, y = of(left), of(right)
                both = len(x & y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[keep, ["a", "b"]]

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").sortWithinPartitions("b")
    return joined.select("a", "b", "left", "right").mapInPandas(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node with an edge (a, b).

    Large-star and small-star steps by turns, each stored, until nothing changes.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(
            e.agg(
                F.count("*"),
                F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")),
            ).first()
        )

    def smallest(e: DataFrame) -> DataFrame:
        return stage(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")

    now = stage(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = None
    after = state(now)
    while after != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(smallest(both), "a").where("b > a").select(F.col("b").alias("a"), "m")
        large = stage(large.where("a <> m").withColumnRenamed("m", "b").distinct(), "large-star")
        least = smallest(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        now = stage(small.unionByName(own).where("a <> b").distinct(), "small-star")
        before, after = after, state(now)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _alike(x: dict, y: dict, percent: int) -> np.ndarray:
    """Pairs (row of x, row of y) that may be linked and whose prefixes count."""
    smaller = np.minimum(x["level"][:, None], y["level"])
    common = np.minimum((x["n"] - x["u"])[:, None], y["n"] - y["u"])
    both = percent * (x["n"][:, None] + y["n"])
    keep = (100 + percent) * common >= both
    keep &= x["comp"][:, None] != y["comp"]
    keep &= np.maximum(x["at"][:, None], y["at"]) <= smaller
    pairs = np.argwhere(keep)
    out = []
    # the sketches of some pairs at a time
    for k in range(0, len(pairs), 1 << 14):
        a, b = pairs[k : k + (1 << 14)].T
        most = np.minimum(x["sketch"][a], y["sketch"][b]).sum(axis=1, dtype=np.int64)
        out.append(pairs[k : k + (1 << 14)][(100 + percent) * most >= both[a, b]])
    return np.concatenate(out) if out else pairs


def pairs_by_token(lists: DataFrame, percent: int, block: int = TOKEN_BLOCK) -> DataFrame:
    """a < b and their smaller level l, once per prefix token that they share and count.

    `lists` has one row per document and token: token, rep, n, u, level, at, comp,
    sketch. The documents of a token are dealt to blocks of about `block`, and a
    task compares two blocks at a time, so a common token is many small tasks.
    """
    counts = lists.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = lists.join(counts, "token").withColumn(
        "own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = dealt.select("*", other).withColumns(
        {"low": F.least("own", "other"), "high": F.greatest("own", "other")}
    )
    key = ["token", "low", "high"]
    ordered = met.repartition(*key).sortWithinPartitions(*key)
    numbers = ["rep", "n", "u", "level", "at", "comp", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(group: list[dict]) -> pa.RecordBatch | None:
            whole = {c: np.concatenate([g[c] for g in group]) for c in (*numbers, "sketch")}
            if len(whole["rep"]) < 2:
                return None
            low, high = group[0]["key"][1:]
            x = {c: v[whole["own"] == low] for c, v in whole.items()}
            y = x if low == high else {c: v[whole["own"] == high] for c, v in whole.items()}
            found = _alike(x, y, percent)
            if low == high:
                found = found[found[:, 0] < found[:, 1]]
            if not len(found):
                return None
            a, b = found.T
            left, right = x["rep"][a], y["rep"][b]
            smaller = np.minimum(x["level"][a], y["level"][b])
            columns = [np.minimum(left, right), np.maximum(left, right), smaller]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "l"])

        held: list[dict] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in key], axis=1)
            if not len(keys):
                continue
            starts = np.nonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))[0]
            columns = {c: batch.column(c).to_numpy().astype(np.int64) for c in numbers}
            sketch = batch.column("sketch")
            flat = sketch.flatten().to_numpy().reshape(-1, SKETCH)
            for k, start in enumerate(starts):
                end = starts[k + 1] if k + 1 < len(starts) else len(keys)
                own = tuple(keys[start].tolist())
                if held and held[0]["key"] != own:
                    out = compared(held)
                    if out is not None:
                        yield out
                    held = []
                part = {c: v[start:end] for c, v in columns.items()}
                held.append({**part, "sketch": flat[start:end], "key": own})
        if held:
            out = compared(held)
            if out is not None:
                yield out

    rows = ordered.select(*key, *numbers, "sketch")
    return rows.mapInArrow(run, "a long, b long, l long")


def choose_prefixes(
    reps: DataFrame, percent: int, most_levels: int = MOST_LEVELS
) -> DataFrame:
    """Adaptive prefixes: rep, n, u, level, and each shared prefix shingle with its level.

    `reps` has rep, n and `found`: (df, token) of the shingles that others share.
    The n - len(found) private ones come first in the order by frequency, so they
    fill the prefix before any shared one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rep, n, found in frame.itertuples(index=False):
                order = sorted((f["df"], f["token"]) for f in found)
                private, alpha = n - len(order), needed(n, percent)
                best, level, size = None, 1, 0
                entries, upto = 0, 0
                for tried in range(1, min(most_levels, alpha) + 1):
                    length = min(len(order), n - alpha + tried - private)
                    while upto < length:
                        entries += order[upto][0]
                        upto += 1
                    cost = entries + VERIFY_COST * entries / tried
                    if best is None or cost < best:
                        best, level, size = cost, tried, max(0, length)
                first = n - alpha + 1 - private
                tokens = [t for _, t in order[:size]]
                levels = [max(1, k - first + 2) for k in range(size)]
                if tokens:
                    own = np.array([t for _, t in order]) & (SKETCH - 1)
                    sketch = np.bincount(own, minlength=SKETCH).astype(np.int32)
                    out.append((rep, n, private, level, sketch, tokens, levels))
            names = ["rep", "n", "u", "level", "sketch", "tokens", "levels"]
            yield pd.DataFrame(out, columns=names)

    return reps.select("rep", "n", "found").mapInPandas(
        run,
        "rep long, n long, u long, level int, sketch array<int>, tokens array<long>,"
        " levels array<int>",
    )


def links(docs: DataFrame, sized: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) between representatives that connect all linked ones."""
    total = sized.agg(F.sum("n_shingles")).first()[0] or 0
    shared = stage(shared_counts(docs, words, total), "shared-counts")
    reps = stage(
        sized.where("doc_id is not null and digest is not null")
        .join(shared, "doc_id")
        .where(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("n_shingles"))
        .groupBy("digest", F.col("n_shingles").alias("n"))
        .agg(F.min("doc_id").alias("rep")),
        "representatives",
    )
    # as many representatives as there may be: never a broadcast
    wanted = reps.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    rep_texts = docs.join(wanted, "doc_id", "left_semi")

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                own = shingles(lower_words(text), words)
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest()
                out.append((doc_id, text, digest, own))
            yield pd.DataFrame(out, columns=["rep", "text", "digest", "tokens"])

    # rows that repeat a doc_id are told apart by the digest of their set
    listed = rep_texts.select("doc_id", "text").mapInPandas(
        tokens, "rep long, text string, digest string, tokens array<long>"
    )
    listed = listed.join(reps, ["rep", "digest"]).groupBy("rep", "digest", "n")
    texts = stage(
        listed.agg(F.min(F.struct("text", "tokens")).alias("t")).select(
            "rep", "n", "t.text", "t.tokens"
        ),
        "candidate-texts",
    )
    rows = texts.select("rep", "n", F.explode("tokens").alias("token"))
    frequency = stage(
        rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies"
    )
    found = (
        rows.join(frequency, "token")
        .groupBy("rep", "n")
        .agg(F.collect_list(F.struct("df", "token")).alias("found"))
        .where(F.lit(100) * F.size("found") >= F.lit(percent) * F.col("n"))
    )
    prefixes = stage(choose_prefixes(found, percent), "prefixes")
    # what each document is known by in a join; its lists carry only its number
    known = prefixes.select("rep", "n", "u", "level", "sketch")
    lists = prefixes.select(
        "rep", "n", "u", "level", F.explode(F.arrays_zip("tokens", "levels")).alias("t")
    ).select("rep", "n", "u", "level", F.col("t.tokens").alias("token"), F.col("t.levels").alias("at"))
    hubs = stage(
        lists.groupBy("token")
        .agg(F.min(F.struct("u", "rep")).alias("hub"), F.count("*").alias("k"))
        .where("k > 1")
        .select("token", F.col("hub.rep").alias("b")),
        "hubs",
    )
    col = F.col
    offered = lists.join(hubs, "token").where("rep <> b").select(col("rep").alias("a"), "b").distinct()
    star = (
        stage(offered, "offered-pairs")
        .join(known.alias("x"), col("a") == col("x.rep"))
        .join(known.alias("y"), col("b") == col("y.rep"))
        .where(possible(percent, "x.", "y."))
        .select("a", "b")
    )
    near_hubs = stage(verify(star, texts, words, percent), "hub-links")
    groups = stage(connected(near_hubs), "hub-components")

    marked = stage(
        lists.join(groups, lists["rep"] == groups["node"], "left").select(
            lists["*"], F.coalesce("component", "rep").alias("comp")
        ),
        "marked-lists",
    )
    # what a token's documents can reach at best; who is out of it meets nobody there
    n, most = F.col("n"), (100 + percent) * (F.col("n") - F.col("u"))
    open_tokens = stage(
        marked.groupBy("token")
        .agg(
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.min("n").alias("least"),
            F.max(most - percent * n).alias("best"),
        )
        .where("low < high")
        .select("token", "least", "best"),
        "open-tokens",
    )
    possibly = (most - percent * n >= percent * F.col("least")) & (F.col("best") >= percent * n)
    live = marked.join(open_tokens, "token").where(possibly).drop("least", "best")
    live = stage(live.join(known.select("rep", "sketch"), "rep"), "live-lists")
    pairs = (
        pairs_by_token(live, percent)
        .groupBy("a", "b", "l")
        .agg(F.count("*").alias("k"))
        .where("k >= l")
        .select("a", "b")
    )
    across = verify(pairs, texts, words, percent)
    return near_hubs.unionByName(across)


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """n_shingles and component_id for every row of `docs` (doc_id, text).

    Two rows are linked when `percent` of the union of their `words`-word shingles
    (A-Z lower-cased) is shared; component_id is the smallest doc_id that links
    reach. Texts with fewer words are one shingle; null and empty ones have none,
    are linked with nothing and are their own component. A null doc_id gives a
    null component and links nothing. Rows that repeat a doc_id are rows of their
    own. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = stage(sizes(own, words), "shingle-sizes")
    edges = links(own, sized, words, percent)
    merged = stage(connected(edges), "components")
    reps = (
        sized.where("doc_id is not null and digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"))
    )
    named = reps.join(merged, reps["rep"] == merged["node"], "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    named = stage(named, "named-sets")
    out = sized.join(named, "digest", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias(
            "component_id"
        ),
    )
