"""SentencePiece rounds, importance resampling and conversation repair against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dispatchlake.llm import (
    audit_paths,
    conversation_repair,
    importance_resampling,
    sentencepiece_rounds,
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_rounds.RoundsEncoder(sentencepiece_rounds.default_path())


def test_pieces_equal_the_library(pieces):
    rnd = random.Random(5)
    parts = ["a", "ab", "the", "▁", " ", "  ", "\n", "é", "日", "😀", "=", "ing", "\x00", "<s>", "n"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(rnd.choices("eainrst hod", k=rnd.randint(0, 80))) for _ in range(3000)]
    texts += [chr(rnd.randint(0x80, 0xD7FF)) * 3 + chr(rnd.randint(0x10000, 0x10FFFF)) for _ in range(500)]
    texts += [" " * k + "x" + " " * k + "\n" for k in range(200)]
    texts += ["a" * 50_000, " " * 50_000, "ab" * 20_000, "0123456789abcdef" * 3_000]
    assert pieces.encode(texts) == pieces.library.encode(texts)
    assert pieces.longest_run == 16  # long runs of blanks go another way


def test_full_cache_forgets_words_not_ids(pieces):
    small = sentencepiece_rounds.RoundsEncoder(sentencepiece_rounds.default_path(), cache_words=10)
    for k in range(5):
        texts = [f"word{j} and word{j + k}" for j in range(20)]
        assert small.encode(texts) == pieces.library.encode(texts)
        assert len(small.known) < 100


def test_piece_documents(docs, empty, fixture_rows, pieces):
    want = Counter()
    for doc_id, text, *_ in fixture_rows:
        ids = pieces.library.encode(text or "")
        want[doc_id, len(ids), sha(",".join(map(str, ids))), sha(pieces.library.decode(ids))] += 1
    got = sentencepiece_rounds.digests(docs)
    assert Counter(map(tuple, got.collect())) == want
    whole = sentencepiece_rounds.encode_documents(docs).collect()
    assert Counter((r.doc_id, len(r.ids), sha(",".join(map(str, r.ids))), sha(r.decoded)) for r in whole) == want
    assert sentencepiece_rounds.digests(empty).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams_of(text, grams):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    out = [" ".join(words[k : k + n]) for n in range(1, grams + 1) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 100 for g in out]


def brute_resample(rows, target, share, least, grams):
    source = Counter(b for _, text in rows for b in grams_of(text, grams)[1])
    wanted = Counter(b for text in target for b in grams_of(text, grams)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = {
        b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 100) / ((source[b] + 1) * (t_all + 100))))
        for b in range(100)
    }
    out = []
    for doc_id, text in rows:
        n_words, found = grams_of(text, grams)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha(f"2024:{'' if doc_id is None else doc_id}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, n_words, len(found), weight, score))
    enough = [r for r in out if r[1] >= least]
    enough.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = Counter()
    for place, row in enumerate(enough[: share[0] * len(enough) // share[1]], 1):
        drawn[(*row, place)] += 1
    left = Counter(out) - Counter(k[:-1] for k in drawn)
    return drawn + Counter({(*k, None): n for k, n in left.items()})


@pytest.mark.parametrize("grams, join_bytes", [(1, 1 << 20), (2, 50), (3, 1 << 20)])
def test_resampling(spark, docs, fixture_rows, grams, join_bytes, monkeypatch):
    monkeypatch.setattr(importance_resampling, "JOIN_BYTES", join_bytes)
    target = ["the quick Brown fox", None, "", "alpha1 beta1 gamma é é", "the dog\nthe dog"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resampling.resample(docs, frame, (60, 100), 4, grams, 100)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rows = [r[:2] for r in fixture_rows]
    assert Counter(map(tuple, got.collect())) == brute_resample(rows, target, (60, 100), 4, grams)


def test_resampling_without_rows(docs, empty, fixture_rows):
    assert importance_resampling.resample(empty, docs).count() == 0
    got = importance_resampling.resample(docs, empty, (50, 100), buckets=100)
    rows = [r[:2] for r in fixture_rows]
    assert Counter(map(tuple, got.collect())) == brute_resample(rows, [], (50, 100), 20, 2)


def brute_path(rows):
    """Cheapest edits by dynamic programming on plain strings."""
    asks, after = "uuau", (2, 2, 3, 2)

    def inserted(best):
        for s in (0, 1, 3, 2):
            if s in best:
                way = (best[s][0] + 5, best[s][1] + "I")
                best[after[s]] = min(best.get(after[s], way), way)
        return best

    best = {0: (0, "")}
    for must, cut, initial in rows:
        new = {}
        for s, (cost, audit) in inserted(best).items():
            ways = [(s, cost + 2, "D")]
            if not must:
                free = initial == asks[s]
                ways.append((after[s], cost + 5 * cut + (not free), "K" if free else "R"))
                if s == 0 and initial == "s":
                    ways.append((1, cost + 5 * cut, "K"))
            for t, c, letter in ways:
                new[t] = min(new.get(t, (c, audit + letter)), (c, audit + letter))
        best = new
    return min(w for s, w in inserted(best).items() if s in (0, 3))


@pytest.mark.parametrize("prime", [audit_paths.PRIME, 5])
def test_paths(prime, monkeypatch):
    monkeypatch.setattr(audit_paths.Audits.__init__, "__defaults__", (audit_paths.BASE, prime))
    rnd = random.Random(7)
    for _ in range(300):
        must = [rnd.random() < 0.2 for _ in range(rnd.randint(0, 40))]
        rows = [(m, not m and rnd.random() < 0.3, rnd.choice(["s", "u", "a", "", "t"])) for m in must]
        assert audit_paths.whole_path(rows) == brute_path(rows)
        size = rnd.randint(1, 9)
        paths = [audit_paths.chunk_paths(rows[k : k + size]) for k in range(0, len(rows), size)]
        chunks = [
            (
                [w and w[0] for ways in p for w in ways],
                [sorted(x[1] for x in ways if x).index(w[1]) if w else None for ways in p for w in ways],
            )
            for p in paths
        ]
        cost, way, closing = audit_paths.chunk_choice(chunks)
        audit = "".join(p[a][b][1] for p, (a, b) in zip(paths, way, strict=True)) + "I" * closing
        assert (cost, audit) == audit_paths.whole_path(rows)


def test_collisions_are_verified():
    clash = audit_paths.Audits(prime=1)  # every hash is 0
    a = b = 0
    for x, y in zip([2, 0, 1, 2], [2, 0, 2, 0], strict=True):
        a, b = clash.push(a, x), clash.push(b, y)
    assert clash.less(a, b) and not clash.less(b, a) and not clash.less(a, a)


def brute_repair(rows):
    """Results of conversations from rows after damage; a missing row has no role."""
    out = Counter()
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == conv and r[2] is not None]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marks, faults = set(), [], Counter()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "dup" if (role, text) in seen else "" if bare[-1] in ".!?" else "cut"
            seen.add((role, text))
            faults[fault] += 1
            marks.append((fault in ("blank", "dup"), fault == "cut", role[:1]))
        cost, audit = brute_path(marks)
        lines, state, at = [], 0, iter(own)
        for letter in audit:
            asked = ("user", "user", "assistant", "user")[state]
            row = None if letter == "I" else next(at)
            if letter == "D":
                continue
            role = row[1] if letter == "K" else asked
            state = 1 if letter == "K" and state == 0 and role[0] == "s" else (2, 2, 3, 2)[state]
            lines.append(f"{role}:{row[2] if row else ''}")
        turns = {r[0] for r in own if r[0] is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        out[
            conv,
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            faults["blank"],
            faults["dup"],
            faults["cut"],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            sha("\n".join(lines)),
        ] += 1
    return out


def turns():
    rnd = random.Random(11)
    texts = ["Hello.", "Why?", "no end", "", " \n", "é!", "twice.", "twice.", None, "long " * 20_000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "", "tool", None]
    rows = [(c, t, rnd.choice(roles), rnd.choice(texts)) for c in range(40) for t in range(rnd.randint(1, 9))]
    # one conversation with most of the rows, one with one text throughout
    rows += [(100, t // 2, rnd.choice(roles[:5]), rnd.choice([f"t{t}.", "same.", "cut"])) for t in range(700)]
    rows += [(101, None, "user", "again.")] * 300
    rows += [(None, 1, "user", "Q?"), (None, None, "system", "S."), (None, 9, "assistant", "A.")]
    return rows


@pytest.mark.parametrize("chunk_rows, ranges", [(4_096, 3), (16, 7), (1, 2)])
def test_repair(spark, chunk_rows, ranges):
    rows = turns()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        frame = frame.withColumns({c: F.lit(0) for c in ("block", "pos", "chunk", "fault", "_row")})
        got = Counter(map(tuple, conversation_repair.repair(frame, chunk_rows).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    blank = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == brute_repair(blank)


def test_damage_and_empty_conversations(spark):
    rows = [r for r in turns() if r[0] != 101]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = []
    for conv, turn, role, text in rows:
        blank = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{blank[0]}:{blank[1]}".encode()) % 20
        role, text = blank[2:]
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(conv, turn, role, text) if kind else (conv, turn, None, None)] * (1 + (kind == 3))
    got = conversation_repair.repair(conversation_repair.damage(frame), 32)
    assert Counter(map(tuple, got.collect())) == brute_repair(damaged)
    lost = spark.createDataFrame([(7, 0, None, None, False)], f"{frame.schema.simpleString()[7:-1]}, present boolean")
    assert [tuple(r) for r in conversation_repair.repair(lost).collect()] == [(7, *[0] * 6, "", sha(""))]
    assert conversation_repair.repair(frame.limit(0)).count() == 0
