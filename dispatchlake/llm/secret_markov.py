"""Secrets in texts: three patterns, and random strings told by Markov models.

DataFrame functions only. Two character bigram models, one of secrets and one of
ordinary words and identifiers, are counted from labelled samples: strings that
the patterns matched and uniformly random ones, against the words of sampled
documents, their short tokens with digits, and identifiers put together from
neighbouring words (names in camel, snake, kebab and upper case, paths, numbered
and dated names). A long token is a secret when its log-likelihood ratio says so,
in total and per character.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the three base kinds
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the whole run, of 18 characters at least
HEX = r"[0-9a-f]{16,}"
ASSIGN_CHARS = 12
KINDS = ("assign", "access", "hex", "random")

CANDIDATE_CHARS = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
WITH_DIGIT = r"[A-Za-z+/_=-]*[0-9][A-Za-z0-9+/_=-]*"
ORDINARY = r"[A-Za-z][A-Za-z_-]{3,}"
SAMPLE_DOCS = 2_000
RANDOM_PAIRS = 20_000
TOTAL_RATIO = 10.0
SHARE = 0.5


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of (start, kind, end, value) of a pattern's matches, in order.

    Gaps between matches come from `split`, matches from `regexp_extract_all`;
    their lengths in code points add up to the places. `keep` may refuse a match
    by its second group; refused ones still use up their characters.

    The sum runs inside blocks of about the root of the number of matches and is
    then carried over the blocks, since adding to an array copies it.
    """
    regex = F.lit(pattern)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    values = F.regexp_extract_all(text, regex, F.lit(2)) if keep else matches
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), matches.alias("m"), values.alias("v")
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value")
        )
        fits = x["m"].isNotNull() & (keep(x["v"]) if keep else F.lit(True))
        found = F.when(fits, F.array_append(acc["found"], span)).otherwise(acc["found"])
        return F.struct(end.alias("pos"), found.alias("found"))

    start = F.struct(F.lit(0).alias("pos"), empty.alias("found"))

    def in_blocks(p: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(p))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(p), size)
        return F.transform(firsts, lambda first: F.aggregate(F.slice(p, first, size), start, step))

    def add(acc: Column, b: Column) -> Column:
        return F.array_append(acc, F.element_at(acc, -1) + b["pos"])

    def carried(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), add)
        moved = F.zip_with(blocks, before, lambda b, n: F.transform(b["found"], lambda s: _moved(s, n)))
        return F.flatten(F.filter(moved, lambda m: m.isNotNull()))

    found = _bound(_bound(parts, in_blocks), carried)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once, though `use` names it in lambdas."""
    return F.transform(F.array(value), use)[0]


def _moved(s: Column, by: Column) -> Column:
    return F.struct(
        (s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"),
        s["value"].alias("value"),
    )


def base_spans(text: Column) -> Column:
    """Spans of the three patterns by start, then kind."""
    long_enough = lambda v: F.length(v) >= ASSIGN_CHARS
    return F.array_sort(
        F.concat(
            spans(text, ASSIGN, 0, long_enough), spans(text, ACCESS, 1), spans(text, HEX, 2)
        )
    )


def bigram_counts(strings: DataFrame) -> DataFrame:
    """Counts of neighbouring characters (as codes) in the column `value`."""
    chars = F.split("value", "")
    pairs = F.zip_with(
        F.slice(chars, F.lit(1), F.size(chars) - 1),
        F.slice(chars, F.lit(2), F.size(chars) - 1),
        lambda a, b: F.ascii(a) * 128 + F.ascii(b),
    )
    long = strings.where(F.length("value") >= 2)
    return long.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def identifiers(words: Column) -> Column:
    """Names as programs and files have them, one from each word and the two after it.

    The form and the numbers follow from a hash of the words, so reruns agree.
    """

    def made(ws: Column) -> Column:
        def name(w: Column, i: Column) -> Column:
            a, b, c = [F.lower(F.coalesce(x, F.lit("x"))) for x in (w, F.get(ws, i + 1), F.get(ws, i + 2))]
            h = F.xxhash64(a, b, c)
            small = F.pmod(h, F.lit(100)).cast("string")
            year = (F.lit(1990) + F.pmod(F.shiftright(h, 8), F.lit(50))).cast("string")
            month = F.lpad((F.lit(1) + F.pmod(F.shiftright(h, 16), F.lit(12))).cast("string"), 2, "0")
            day = F.lpad((F.lit(1) + F.pmod(F.shiftright(h, 24), F.lit(28))).cast("string"), 2, "0")
            forms = [
                F.concat(a, F.initcap(b), F.initcap(c)),
                F.concat(F.initcap(a), F.initcap(b), small),
                F.concat_ws("_", a, b, c),
                F.concat_ws("_", a, b, F.concat(F.lit("v"), small)),
                F.upper(F.concat_ws("_", a, b, small)),
                F.concat_ws("-", a, b, c),
                F.concat_ws("/", F.lit(""), a, b, c),
                F.concat_ws("/", a, year, month, F.concat(b, small)),
                F.concat_ws("-", year, month, day, a, b),
                F.concat(a, F.lit("_"), year, month, day, F.lit("_"), b),
            ]
            return F.element_at(F.array(*forms), (F.pmod(F.shiftright(h, 32), F.lit(len(forms))) + 1).cast("int"))

        return F.transform(ws, name)

    return _bound(words, made)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log ratios, secret to ordinary, for each pair of ASCII characters.

    Both samples are bounded by `sample_docs` documents, those with the smallest
    hashes: of documents with a match, the matched values, and of all documents
    the ordinary words. Only values and hashes meet in the task that finds the
    smallest; the texts of the second sample are read by a join with its hashes
    (`sample_docs` numbers, broadcast), all copies of a chosen row among them. The
    driver gets at most 2 x 16384 counts.

    Ordinary are the words, the `identifiers` made of them, and what has digits
    outside the patterns' spans but is too short to be judged; longer tokens with
    digits are not labelled and so not learnt from.
    """
    keyed = docs.select("text", F.xxhash64("text", "doc_id").alias("key"))
    labelled = (
        keyed.where(
            F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)
        )
        .select("key", F.transform(base_spans(F.col("text")), lambda s: s["value"]).alias("values"))
        .orderBy("key")
        .limit(sample_docs)
        .select(F.explode("values").alias("value"))
    )
    outside = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        outside = F.regexp_replace(outside, pattern, " ")
    words = F.regexp_extract_all(F.regexp_replace(outside, WITH_DIGIT, " "), F.lit(ORDINARY), F.lit(0))
    numbered = F.filter(
        F.regexp_extract_all(outside, F.lit(WITH_DIGIT), F.lit(0)),
        lambda t: F.length(t) < CANDIDATE_CHARS,
    )
    texts = keyed.where("text is not null")
    smallest = texts.select("key").orderBy("key").limit(sample_docs)
    ordinary = (
        texts.join(F.broadcast(smallest), "key", "left_semi")
        .select(F.explode(F.concat(words, identifiers(words), numbered)).alias("value"))
    )
    both = (
        bigram_counts(labelled)
        .select("pair", F.col("n").alias("secret"), F.lit(0).cast("long").alias("ordinary"))
        .unionByName(
            bigram_counts(ordinary).select(
                "pair", F.lit(0).cast("long").alias("secret"), F.col("n").alias("ordinary")
            )
        )
        .groupBy("pair")
        .agg(F.sum("secret").alias("secret"), F.sum("ordinary").alias("ordinary"))
        .where("pair < 16384")
        .collect()
    )
    return log_ratios({r["pair"]: (r["secret"], r["ordinary"]) for r in both})


def log_ratios(
    counts: dict[int, tuple[int, int]], alphabet: int = 67, random_pairs: int = RANDOM_PAIRS
) -> list[float]:
    """Smoothed transition log-likelihood ratios from bigram counts.

    The secret model also gets the expected counts of `random_pairs` pairs of
    uniformly random letters and digits, a labelled sample of their kind. A
    character that a model has seldom seen borrows the transitions of its kind
    (small letter, capital, digit, other), a tenth of it as if all characters
    were alike, so that a small corpus still tells mixed strings from words.
    """
    counts = dict(counts)
    alnum = [ord(c) for c in string.ascii_letters + string.digits]
    for a in alnum:
        for b in alnum:
            secret, ordinary = counts.get(a * 128 + b, (0, 0))
            counts[a * 128 + b] = (secret + random_pairs / len(alnum) ** 2, ordinary)
    sizes = [26, 26, 10, alphabet - 62]
    rows = [[0.0, 0.0] for _ in range(128)]
    kinds = [[[0.0, 0.0] for _ in sizes] for _ in sizes]
    for pair, found in counts.items():
        a, b = divmod(pair, 128)
        for k in (0, 1):
            rows[a][k] += found[k]
            kinds[character_kind(a)][character_kind(b)][k] += found[k]
    mass = 0.5 * alphabet
    out = []
    for pair in range(128 * 128):
        a, b = divmod(pair, 128)
        own, other = kinds[character_kind(a)], character_kind(b)
        logs = []
        for k in (0, 1):
            share = sizes[other] / alphabet
            like = (own[other][k] + mass * share) / (sum(n[k] for n in own) + mass)
            prior = 0.1 / alphabet + 0.9 * like / sizes[other]
            n = counts.get(pair, (0, 0))[k]
            logs.append(math.log((n + mass * prior) / (rows[a][k] + mass)))
        out.append(round(logs[0] - logs[1], 4))
    return out


def random_gain(table: list[float]) -> float:
    """Mean log ratio of a transition in uniformly random letters and digits."""
    alnum = [ord(c) for c in string.ascii_letters + string.digits]
    return sum(table[a * 128 + b] for a in alnum for b in alnum) / len(alnum) ** 2


def character_kind(code: int) -> int:
    """0 small letter, 1 capital, 2 digit, 3 any other."""
    c = chr(code)
    return 0 if c in string.ascii_lowercase else 1 if c in string.ascii_uppercase else 2 if c in string.digits else 3


def log_ratio(value: Column, ratios: Column) -> Column:
    """Sum of the log ratios along a string of ASCII characters."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    pairs = F.zip_with(
        F.slice(codes, F.lit(1), F.size(codes) - 1),
        F.slice(codes, F.lit(2), F.size(codes) - 1),
        lambda a, b: F.element_at(ratios, a * 128 + b + 1),
    )
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def find_secrets(
    docs: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    total_ratio: float = TOTAL_RATIO,
    share: float = SHARE,
    table: list[float] | None = None,
) -> DataFrame:
    """`docs` with `base` and `spans`: arrays of (start, kind, end, value).

    A long token is a random string when its log ratio reaches `total_ratio`, and per
    transition `share` of what uniformly random letters and digits reach on average.
    `table` holds the ratios of an earlier `train`; without it `docs` are learnt from.

    Places are code points, end exclusive; `kind` indexes KINDS. `base` holds the
    three patterns' spans, `spans` these and the random strings beside them, by
    start, then kind; what a pattern leaves of a long token is judged by itself. Null and empty texts have none; all rows and
    columns of `docs` stay, repeated ones too, and an empty table stays empty.
    Columns named `base` or `spans` are replaced.
    """
    table = table or train(docs, sample_docs)
    mean_ratio = share * random_gain(table)
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    candidates = spans(blanked(text, F.col("base")), CANDIDATE, 3)

    def random(s: Column) -> Column:
        ratio = log_ratio(s["value"], ratios)
        return ratio >= F.greatest(F.lit(total_ratio), (F.length(s["value"]) - 1) * F.lit(mean_ratio))

    found = docs.withColumn("base", base_spans(text))
    return found.withColumn(
        "spans", F.array_sort(F.concat("base", F.filter(candidates, random)))
    )


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(
                ":",
                F.element_at(names, s["kind"] + 1),
                s["start"].cast("string"),
                s["end"].cast("string"),
            ),
        ),
        ",",
    )


def report(found: DataFrame) -> DataFrame:
    """Counts, digest and list of spans per document of `find_secrets`."""
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def pieces(text: Column, found: Column, mark) -> Column:
    """`text` with each span replaced by `mark(n, joined)`.

    Spans come by start. `n` is the number of characters that no earlier span
    covers, `joined` tells that the span begins inside an earlier one. The furthest
    end so far is carried like the places in `spans`.
    """

    def ends(sp: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(sp))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(sp), size)
        tops = F.transform(firsts, lambda f: F.array_max(F.transform(F.slice(sp, f, size), lambda s: s["end"])))
        top = lambda acc, t: F.array_append(acc, F.greatest(F.element_at(acc, -1), t))

        def block(first: Column, before: Column) -> Column:
            # without the last: the end before each span of the block
            inside = F.slice(sp, first, F.least(size, F.size(sp) - first + 1))
            return F.slice(
                F.aggregate(inside, F.array(before), lambda a, s: top(a, s["end"])), F.lit(1), F.size(inside)
            )

        starts = F.aggregate(tops, F.array(F.lit(0)), top)
        whole = F.zip_with(firsts, F.slice(starts, F.lit(1), F.size(firsts)), block)
        return F.arrays_zip(sp.alias("s"), F.flatten(whole).alias("before"))

    def piece(x: Column) -> Column:
        start, end, before = x["s"]["start"], x["s"]["end"], x["before"]
        gap = F.substring(text, before + 1, F.greatest(start - before, F.lit(0)))
        n = F.greatest(end - F.greatest(start, before), F.lit(0))
        return F.concat(gap, mark(n, start < before))

    last = F.array_max(F.transform(found, lambda s: s["end"]))
    done = F.array_join(F.transform(_bound(found, ends), piece), "")
    whole = F.concat(done, F.substring(text, last + 1, F.length(text) - last))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def blanked(text: Column, found: Column) -> Column:
    """`text` with blanks in place of its spans, so that all places stay."""
    return pieces(text, found, lambda n, joined: F.repeat(F.lit(" "), n))


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`find_secrets` output with every span of the text replaced by `mark`.

    Overlapping spans are replaced as one. Texts without spans stay as they are.
    """
    once = lambda n, joined: F.when(joined, "").otherwise(mark)
    return found.withColumn("text", pieces(F.col("text"), F.col("spans"), once))
