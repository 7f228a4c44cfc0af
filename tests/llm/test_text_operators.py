"""Operators on whole texts, against brute force and the tokenizers library."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, decontamination, encoding, media, sharding, suffix_dedup, token_counts, token_files
from tessera.llm.encoding import WORD_BPE
from tests.conftest import SF
from tests.llm.conftest import PASSAGE, frame, prose, texts


def key(x):
    return (x is None, x)


def plain(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: [key(x) for x in r])


def brute_spans(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for (i, _), x in zip(rows, data, strict=True):
        gone = bytearray(len(x))
        for at in range(len(x) - length + 1):
            if seen[x[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: [key(x) for x in r])


@pytest.mark.parametrize(("length", "gram", "hot"), [(200, 48, 4096), (24, 8, 4096), (24, 8, 3), (8, 8, 2)])
def test_substring_dedup(spark, hostile, length, gram, hot):
    rows = [(i, t) for i, t in texts() if i != 11] if length < 200 else texts()
    docs = hostile.where(F.coalesce("doc_id", F.lit(0)) != 11) if length < 200 else hostile
    found = suffix_dedup.dedup_substrings(docs, length, gram, hot)
    n = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    got = plain(found.select("doc_id", "n_bytes", n.alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")), "doc_id", "n_bytes", "n", "s", "h")
    assert got == brute_spans(rows, length)


def test_substring_dedup_tables(spark, nothing):
    assert suffix_dedup.dedup_substrings(nothing).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert plain(suffix_dedup.op1_suffix_dedup(spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_spans(rows, 200)


def brute_leaks(rows, items, similarity=0.8):
    items = [x for x in (decontamination.Item(i, t or "") for i, t in items) if x.all]
    span = max([len(x.words) for x in items], default=5)
    found = set()
    for i, t in rows:
        words = decontamination.words_of(t or "")
        for start in range(0, max(1, len(words)), span):
            there = set(decontamination.shingles(words[start : start + 2 * span]))
            for x in items:
                got = [decontamination.share(p, there) for p in (x.all, x.question, x.answer)]
                if got[0] >= similarity and min(got[1:]) >= similarity / 2:
                    found.add((i, x.id))
    return sorted(found, key=lambda r: [key(x) for x in r])


def test_decontamination(spark, hostile, nothing):
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[:40])), (2, prose(4, 20_000)[5000:5400]), (3, None), (4, ""), (5, "too few words"), (6, prose(77, 60)), (7, prose(3, 90)[:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_leaks(hostile, bench)
    assert sorted({(r["doc_id"], r["item_id"]) for r in found.collect()}, key=lambda r: [key(x) for x in r]) == brute_leaks(texts(), items)
    sliced = decontamination.find_leaks(hostile, bench, slice_chars=500)
    assert {(r["doc_id"], r["item_id"]) for r in sliced.collect()} == {(r["doc_id"], r["item_id"]) for r in found.collect()}
    left = decontamination.drop_leaks(hostile, bench)
    assert left.columns == hostile.columns
    leaked = {r["doc_id"] for r in found.collect()}
    assert {9, 10} <= leaked
    assert left.count() == sum(i not in leaked for i, _ in texts())
    assert decontamination.find_leaks(nothing, bench).count() == 0
    assert decontamination.find_leaks(hostile, bench.limit(0)).count() == 0
    assert decontamination.drop_leaks(hostile, bench.limit(0)).count() == len(texts())


def test_decontamination_of_edited_items(spark):
    """Any word changed or the last one missing: more than 0.8 of the item is there, whatever is left of its answer."""
    words = prose(31, 55).replace(".", "").replace(",", "").split()
    item = " ".join(words[:52]) + ". " + " ".join(words[52:])
    edited = [item.rsplit(" ", 1)[0], *(" ".join([*item.split()[:i], "edited", *item.split()[i + 1 :]]) for i in range(55))]
    two = item.split()
    two[44] = two[49] = "edited"  # ten of 51 shingles, all near the end
    rows = [(i, f"{prose(900 + i, 30)} {x} {prose(990 + i, 30)}") for i, x in enumerate([*edited, " ".join(two)])]
    half = (99, " ".join(words[:30]))
    docs, bench = frame(spark, [*rows, half]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.find_leaks(docs, bench).collect()} == {i for i, _ in rows}
    assert [r["doc_id"] for r in decontamination.drop_leaks(docs, bench).collect()] == [99]


def test_decontamination_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted({(r["doc_id"], r["item_id"]) for r in decontamination.op2_decontamination(spark, SF).collect()}) == brute_leaks(rows, items)


def byte_bpe(rows):
    t = Tokenizer.from_file(bpe.BYTE_BPE)
    t.no_truncation(), t.no_padding()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        yield i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("size", [0, 5, 50_000])
def test_bpe(spark, hostile, nothing, size):
    got = bpe.encode_digest(hostile, bpe.BYTE_BPE, bpe.build_lexicon(hostile, bpe.BYTE_BPE, max(size, 1)))
    assert plain(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(byte_bpe(texts()), key=lambda r: [key(x) for x in r])
    assert bpe.encode_digest(nothing, bpe.BYTE_BPE, bpe.build_lexicon(nothing, bpe.BYTE_BPE)).count() == 0


@pytest.mark.parametrize("flush", [10, 400_000])
def test_word_counts(spark, hostile, nothing, flush):
    """Every occurrence counts, also of words met once, however often a task hands on its counts."""
    got = [(x["word"], x["n"]) for x in bpe.word_counts(hostile, flush=flush).collect()]
    want = Counter(w for _, t in texts() for w in bpe.PIECE.findall(t or ""))
    assert len(got) == len(want) and dict(got) == want
    assert bpe.word_counts(nothing).count() == 0


def test_most_frequent(spark):
    rows = [(f"w{i:03d}", n) for i, n in enumerate([9, 9, 5, 1, 5, 1, 5, 1, 2])]
    counts = spark.createDataFrame(rows[::-1], "word string, n long")
    order = [w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for size in range(1, 12):
        assert sorted(bpe.most_frequent(counts, size)) == sorted(order[:size])
    assert bpe.most_frequent(counts.where("n > 9"), 3) == []


def test_bpe_real_outputs(spark, hostile):
    lexicon = bpe.build_lexicon(hostile, bpe.BYTE_BPE)
    rows = {(r["doc_id"], len(r["ids"])) for r in bpe.encode_decode(hostile, bpe.BYTE_BPE, lexicon).collect()}
    same = bpe.encode_digest(hostile, bpe.BYTE_BPE, lexicon, with_ids=True).collect()
    assert rows == {(r["doc_id"], r["n_tokens"]) for r in same}
    assert all(hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"] for r in same)


def test_bpe_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert plain(bpe.op3_bpe(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(byte_bpe(rows))


def word_bpe(rows, end, special_as_text=False):
    import numpy as np

    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation(), t.no_padding()
    t.encode_special_tokens = special_as_text
    start = 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, end]
        yield i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files(spark, hostile, nothing):
    got = plain(token_files.read_files(*token_files.token_files(hostile, WORD_BPE, 1)), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(word_bpe(texts(), 1), key=lambda r: [key(x) for x in r])
    assert token_files.read_files(*token_files.token_files(nothing, WORD_BPE, 1)).count() == 0


def test_token_files_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert plain(token_files.op4_token_files(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(word_bpe(rows, 1))


def test_code_lengths():
    import numpy as np

    counts = np.array([2**i for i in range(20)] + [0])
    lengths = token_files.limited_lengths(counts, 8)
    assert lengths[-1] == 0 and lengths[:-1].max() <= 8 and sum(2.0 ** -int(x) for x in lengths if x) <= 1


def test_token_counts(spark, hostile, nothing):
    for block in (7, 1 << 17):
        files = token_counts.flat_files(hostile, WORD_BPE, token_counts.SEPARATOR, block=block)
        got = plain(token_counts.count_tokens(files, token_counts.SEPARATOR, 2), "doc_id", "n_tokens")
        assert got == sorted(((i, n - 1) for i, _, n, _ in word_bpe(texts(), 1, True)), key=lambda r: [key(x) for x in r])
    assert token_counts.count_tokens(token_counts.flat_files(nothing, WORD_BPE, token_counts.SEPARATOR), token_counts.SEPARATOR, 2).count() == 0


def test_token_counts_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert plain(token_counts.op6_token_counts(spark, SF), "doc_id", "n_tokens") == sorted((i, n - 1) for i, _, n, _ in word_bpe(rows, 1, True))


def test_sharding(spark, hostile, nothing):
    got = sharding.shard_records(hostile).collect()
    assert sorted((key(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((key(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts())
    for shard in range(16):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    assert sharding.shard_records(nothing).count() == 0
    many = sharding.shard_records(spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text"), weights=(1.0, 2.0, 1.0)).groupBy("shard").count().orderBy("shard").collect()
    assert [round(r["count"] / 5000) for r in many] == [1, 2, 1]


def test_sharding_table(spark):
    """The registered query against the highest of plainly recomputed scores."""
    import math

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    shards = range(17)
    drawn = rows.select("doc_id", *[F.xxhash64(F.lit(17), F.concat(F.lit("k"), F.col("doc_id").cast("string")), F.lit(j)).alias(f"h{j}") for j in shards]).collect()
    best = {}
    for r in drawn:
        scores = [-1 / math.log((r[f"h{j}"] % 2**52 + 0.5) / 2**52) for j in shards]
        best[r["doc_id"]] = tuple(max(range(n), key=lambda j: (scores[j], -j)) for n in (16, 17))
    got = sharding.op5_sharding(spark, SF).collect()
    assert {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in got} == best and {r["law"] for r in got} == {"key"}
    for shard in range(16):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_media(spark, hostile, nothing):
    got = plain(media.read_media(media.write_media(hostile)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_error")
    want = []
    for i, t in texts():
        raw = (t or "").encode()
        padded = media.pad(raw, 192)
        assert len(padded) % 192 == 0 and padded.startswith(raw) and not padded[len(raw) :].strip(b" ")
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), None))
    assert got == sorted(want, key=lambda r: [key(x) for x in r])
    assert media.read_media(media.write_media(nothing)).count() == 0


def plain_unfilter(lines, width=3):
    """The row filters as the PNG format says, byte after byte."""
    out, prior = [], [0] * (len(lines[0]) - 1)
    for line in lines:
        kind, row = line[0], []
        for i, x in enumerate(line[1:]):
            a, b, c = row[i - width] if i >= width else 0, prior[i], prior[i - width] if i >= width else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((x + [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append(row)
        prior = row
    return out


def test_png_filters():
    """All five filters on every row of images of several heights, told apart from a plain reader; chosen filters differ."""
    import numpy as np

    rng = np.random.default_rng(2)
    heights = [1, 7, 2, 30]
    images = [rng.integers(0, 256, (h, 24), dtype=np.uint8) for h in heights]
    first = media._first_rows(heights)
    for kinds in (*[np.full(40, k) for k in range(5)], rng.integers(0, 5, 40)):
        lines = media.filter_rows(np.concatenate(images), first, kinds)
        assert (lines[:, 0] == kinds).all()
        assert (media.unfilter_rows(lines, first) == np.concatenate(images)).all()
        at = 0
        for image in images:
            assert plain_unfilter(lines[at : at + len(image)].tolist()) == image.tolist()
            at += len(image)
    payloads = [media.pad(t.encode(), 192) for t in (prose(1, 400), "", "x" * 192)]
    files = media.encode_images(payloads)
    assert len({k for f in files for k in media.read_lines(f)[:, 0].tolist()}) > 1
    assert [x.tobytes() for x in media.decode_images(files)] == payloads
    assert isinstance(media.decode_images([b"no image"])[0], ValueError)


def test_cosine_hash_of_plain_transform():
    import math
    from statistics import median

    import numpy as np

    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 256, (64, 32, 3), dtype=np.uint8)
    grey = pixels.astype(float) @ np.array([0.299, 0.587, 0.114])
    small = grey.reshape(32, 2, 32).mean(axis=1)
    c = lambda k: math.sqrt((1 if k == 0 else 2) / 32)
    low = [[c(u) * c(v) * sum(small[y, x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    flat = [x for row in low for x in row]
    middle = median(flat[1:])
    bits = "".join("0" if i == 0 else str(int(x > middle)) for i, x in enumerate(flat))
    assert media.cosine_hash(pixels) == f"{int(bits, 2):016x}"


def test_media_table(spark):
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = media.op7_media(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = media.pad(rows[r["doc_id"]], 192)
        (file,) = media.encode_images([payload])
        assert (r["payload_sha256"], r["media_sha256"], r["media_error"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(file).hexdigest(), None)


def test_media_rejects_damage(spark, hostile):
    images = media.write_media(hostile.where("doc_id in (1, 6)")).collect()
    damaged = [(r["doc_id"], r["n_bytes"], bytes([*r["media"][:-20], r["media"][-20] ^ 1, *r["media"][-19:]])) for r in images]
    out = media.read_media(spark.createDataFrame(damaged, "doc_id long, n_bytes long, media binary")).collect()
    assert all(r["payload_sha256"] is None and r["media_error"] for r in out)


@pytest.mark.parametrize("special", [False, True])
def test_piece_encoder_is_the_library(special):
    """Every character of Latin-1 alone, inside words, at both ends and in pairs, and texts dealt from hard parts."""
    import random

    import numpy as np

    from tessera.llm.encoding import PieceEncoder

    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation(), t.no_padding()
    t.encode_special_tokens = special
    chars = [chr(i) for i in range(256)]
    r = random.Random(8)
    parts = [*chars, "é", "é", "日本", "😀", "it's", "'LL", "don't", "½", "<|endoftext|>", "<|startoftext|", " ", "​", "ǅ", "word", "THE", "%%%", "12345"]
    some = [x for c in chars for x in (c, f"wo{c}rd", f"{c}word", f"word{c}", f" {c} ")]
    some += [a + b for a in chars for b in r.sample(chars, 24)] + ["".join(r.choices(parts, k=r.randrange(1, 14))) for _ in range(5000)]
    encoder = PieceEncoder(WORD_BPE, 2, special, limit=3000)
    got = [np.frombuffer(x, "<u2").tolist() for i in range(0, len(some), 500) for x in encoder.encode(some[i : i + 500])]
    want = [x.ids for x in t.encode_batch_fast(some, add_special_tokens=False)]
    assert [(x, a, b) for x, a, b in zip(some, got, want, strict=True) if a != b] == []


def test_encoder_looks_each_different_piece_up_once(monkeypatch):
    """However often a piece is in a batch, and with white space of all kinds at both ends of texts."""
    asked, look_up = [], encoding.Numbered.look_up
    monkeypatch.setattr(encoding.Numbered, "look_up", lambda self, pieces, *rest: (asked.append(pieces), look_up(self, pieces, *rest))[1])
    given = ["a word, a word", "", " \n", "　word a ", "\x85word\x1ca", "word İstanbul ẞ É's\t"]
    encoder = encoding.PieceEncoder(encoding.WORD_BPE, 2, special_as_text=False, limit=4)
    tokenizer = Tokenizer.from_file(encoding.WORD_BPE)
    for _ in range(2):  # the second time from memory, which has been cut down to the limit
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(given)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in given]
        assert len(asked[0]) == len(set(asked[0])) and {"a", "word", "word,"} <= set(asked[0])
        asked.clear()
    assert encoder.encode([]) == []
