"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd input."""

import dataclasses
import itertools
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, difference
from tests.conftest import SMALL
from tidewell.llm import audio, decontaminate, line_dedup, near_dedup, packing, quality, registry, sharding, token_counts, toxicity, url_filter, words
from tidewell.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("id", "d", "n", "h", "t", "x", "s", "key", "rank", "score", "row", "shard", "line", "sig", "spans", "hit", "bin", "duplicate_of")


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    return df.select("*", *(F.lit(f"own-{c}").alias(c) for c in CLASHES)) if extra else df


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def sentence(rng, n=14):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


ODD = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, "   \n\n ", None), (4, "x" * 50_000, "b"), (4, "x" * 50_000, "b"), (None, "plain words of a clean text that no one else has written down", "c"), (5, "!!! ??? ...", "c")]


# --- 1 line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def brute_lines(rows, distance=edits):
    occ = sorted({((i is None, i or 0, n), line.strip(" ")) for i, t, _ in rows for n, line in enumerate((t or "").split("\n")) if line.strip(" \t\r")})
    first = {}
    for place, line in occ:
        first.setdefault(line, place)
    hit = {}
    for a, b in itertools.combinations(first, 2):
        most = int(line_dedup.limit(min(len(a), len(b))))
        if abs(len(a) - len(b)) <= most and most and (d := distance(a, b)) <= most:
            early, late = sorted((a, b), key=first.get)
            hit[late] = min(hit.get(late, ((True,), 0)), (first[early], d))
    plain = lambda p: (None if p[0] else p[1], p[2])
    out = set()
    for place, line in occ:
        if line in hit:
            out.add((*plain(place), *plain(hit[line][0]), hit[line][1]))
        elif place > first[line]:
            out.add((*plain(place), *plain(first[line]), 0))
    return sorted(out, key=repr)


def found_lines(spark, rows, **how):
    return tuples(line_dedup.duplicate_lines(docs_of(spark, rows), **how), "doc_id", "line_no", "dup_doc_id", "dup_line_no", "distance")


def changed(rng, s, most):
    for _ in range(rng.randint(0, most)):
        k = rng.randrange(len(s))
        s = rng.choice([s[:k] + s[k + 1 :], s[:k] + "é" + s[k:], s[:k] + "q" + s[k + 1 :]]) or "q"
    return s


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    base = [sentence(rng, 8) for _ in range(12)] + ["".join(rng.choice("ab c") for _ in range(n)) for n in range(1, 41)] + [sentence(rng, 25) for _ in range(4)]
    rows = [(i if i % 9 else None, "\n".join(changed(rng, rng.choice(base), 5) for _ in range(5)), "s") for i in range(60)]
    want = brute_lines(rows)
    assert found_lines(spark, rows) == want and {x[-1] for x in want} >= {0, 1, 2, 3, 4}
    assert found_lines(spark, rows, broadcast_ids=0) == want
    assert found_lines(spark, [(1, "Copyright 2024 ACME", "s"), (2, " a\n\t\n\na ", "s"), (3, "Copyright 2024 ACME", "s")]) == [(2, 3, 2, 0, 0), (3, 0, 1, 0, 0)]


def test_long_lines_within_their_limit(spark):
    """Swapped words are more than two edits; the limit grows with the line."""
    rng = random.Random(14)
    base = [sentence(rng, n) for n in (40, 90, 150, 280, 500)]
    rows = []
    for k, line in enumerate(base * 3):
        ws = line.split()
        if k >= len(base):
            at = rng.randrange(len(ws) - 1)
            ws[at], ws[at + 1] = ws[at + 1], ws[at]
        rows.append((k, " ".join(ws), "s"))
    want = brute_lines(rows, lambda a, b: 10**6 if (d := line_dedup.edit_distance(a, b, 100)) is None else d)
    assert found_lines(spark, rows) == want and len(want) == 2 * len(base) and max(x[-1] for x in want) > 4


def test_hot_segments(spark):
    """Lines that share a segment alone emit no pair; variants of a template are compared in blocks, each link found."""
    import pyarrow as pa

    rng = random.Random(15)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    head = "the same long beginning of them all, with which every one of the lines starts: "
    apart = [head + letters(100) for _ in range(4000)]
    batch = lambda lines: iter([pa.record_batch([pa.array(lines)], ["line"])])
    met = lambda lines, level: [r for b in line_dedup._meet(iter(sorted_blobs(line_dedup._post(3, level)(batch(lines))))) for r in b.to_pylist()]

    def sorted_blobs(blobs):
        return pa.Table.from_batches(list(blobs)).sort_by("pid").combine_chunks().to_batches()

    first = met(apart, 1)
    assert sum(r["key"] == 0 for r in first) < 50 and sum(r["key"] != 0 for r in first) >= 4000
    assert sum(r["key"] == 0 for r in met(apart, 2)) < 4000
    template = "Permission is granted to {} to use, copy and change this work and to give it away, under the terms that are named below"
    rows = [(k, line, "s") for k, line in enumerate(apart[:700])]
    rows += [(1000 + k, template.format(letters(3)), "s") for k in range(400)] + [(2000 + k, template.format(letters(6)) + letters(rng.randint(0, 3)), "s") for k in range(100)]
    rng.shuffle(rows)
    far = lambda a, b: 10**6 if (d := line_dedup.edit_distance(a, b, int(line_dedup.limit(min(len(a), len(b)))))) is None else d
    want = brute_lines(rows, far)
    assert found_lines(spark, rows) == want and len(want) > 350


def test_edit_distance():
    rng = random.Random(2)
    for k in range(6000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = changed(rng, a, 4) if a and k % 2 else "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        d, most = edits(a, b), rng.randint(0, 6)
        assert line_dedup.edit_distance(a, b, most) == (d if d <= most else None)
    pairs = []
    for k in range(3000):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 1500) if k % 9 == 0 else rng.randint(1, 300)))
        pairs.append((a, changed(rng, a, 3 + len(a) // 25)))
    want = [line_dedup.edit_distance(a, b, int(line_dedup.limit(min(len(a), len(b))))) for a, b in pairs]
    assert line_dedup.edit_distances(pairs) == want and None in want and len(set(want)) > 20 and line_dedup.edit_distances([]) == []


@pytest.mark.parametrize("level", [1, 2])
def test_segments_meet(level):
    """Any two lines within their limit share a key, by a segment of one of them."""
    rng = random.Random(16)
    for k in range(400):
        a = "".join(rng.choice("abcdefgh ") for _ in range(2500 if k % 100 == 0 else rng.randint(15, 700)))
        b = changed(rng, a, int(line_dedup.limit(len(a))))
        if len(b) >= 15 and line_dedup.edit_distance(a, b, int(line_dedup.limit(min(len(a), len(b))))) is not None:
            who, key, probe = line_dedup.entries([a, b], level)
            own = [{int(x) for x, w, p in zip(key, who, probe, strict=True) if w == i and not p} for i in (0, 1)]
            every = [{int(x) for x, w in zip(key, who, strict=True) if w == i} for i in (0, 1)]
            assert own[0] & every[1] or own[1] & every[0]


def test_drop_lines(spark):
    line = "this very line is found in more than one document here"
    rows = [*ODD, (10, f"{line}\nfirst only", "a"), (11, f"{line}\nsecond one", "a"), (12, line, "a"), (13, f"  {line[:-1]} \nthird", "a")]
    out = line_dedup.drop_duplicate_lines(docs_of(spark, rows))
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["h"]) for r in out.collect() if (r["doc_id"] or 0) >= 10}
    assert got == {10: (f"{line}\nfirst only", len(line) + 11, "own-h"), 11: ("second one", 10, "own-h"), 13: ("third", 5, "own-h")}
    kept = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {(i, t) for i, t, _ in ODD} <= kept and out.columns == docs_of(spark, rows).columns


# --- 2 quality


def test_quality_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    half = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0)
    got = quality.quality_scores(docs, half).join(labels.join(half, "doc_id", "left_anti"), "doc_id").toPandas()
    assert len(got) > 100 and (got["keep"] == (got["quality"] > 0)).mean() >= 0.9
    assert got["probability"].between(0, 1).all()


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(3)
    n, p = rng.integers(1, 5, 12).astype(float), rng.random(12)
    s, q = quality.isotonic(np.arange(12.0), p * n, n)
    assert (np.diff(q) >= -1e-12).all()
    want = [min(max((p[a : b + 1] * n[a : b + 1]).sum() / n[a : b + 1].sum() for a in range(i + 1)) for b in range(i, 12)) for i in range(12)]
    want = [max(min((p[a : b + 1] * n[a : b + 1]).sum() / n[a : b + 1].sum() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    assert np.allclose(q, want)


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs_of(spark, ODD), labels)
    assert got.count() == len(ODD) and {r["probability"] for r in got.collect()} == {0.5}
    assert quality.quality_scores(docs_of(spark, ODD).limit(0), labels).count() == 0


def test_fit_is_that_of_one_pass(spark):
    """The model summed over partitions, against one ridge regression and one calibration in NumPy over all rows."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, quality._D)).astype(np.float32)
    x[50:60] = x[50]  # ties
    y = (x[:, 0] + rng.normal(0, 0.5, 600) > 0).astype(float)
    stats = spark.createDataFrame([(f"d{i}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, x array<float>").repartition(7)
    labels = spark.createDataFrame([(f"d{i}", int(v)) for i, v in enumerate(y)] + [("d1", 0), (None, 1), ("d2", None)], "doc_id string, quality int")
    m = quality.fit(stats, labels)
    held = np.array([bool(r[0]) for r in stats.orderBy(F.substring("id", 2, 9).cast("int")).select(F.pmod(F.xxhash64("id"), F.lit(quality.CALIBRATE)) == 0).collect()])
    t, u = x[~held].astype(float), y[~held]
    frequency, phase = quality.frequencies()
    z = np.cos(np.clip((t - t.mean(axis=0)) / t.std(axis=0), -8, 8) @ frequency + phase) * np.sqrt(2 / quality.FEATURES)
    z = np.concatenate((z, np.ones((len(z), 1))), axis=1)
    eye = quality.RIDGE * len(z) * np.eye(z.shape[1])
    eye[-1, -1] = 0
    w = np.linalg.solve(z.T @ z + eye, z.T @ u)
    assert np.allclose(m.scores(t), z @ w, atol=1e-6)
    score = np.round(m.scores(x[held].astype(float)), 3)
    values = np.unique(score)
    total = np.array([(score == v).sum() for v in values], float)
    positive = np.array([y[held][score == v].sum() for v in values])
    p = positive / total
    sums = lambda a, b: positive[a : b + 1].sum() / total[a : b + 1].sum()
    want = [max(min(sums(a, b) for b in range(i, len(p))) for a in range(i + 1)) for i in range(len(p))]
    assert np.allclose(m.probability(values), want, atol=1e-9)


# --- 3 audio


def wav(samples, rate, bits=16, channels=1):
    body = samples.astype({8: np.uint8, 16: "<i2"}[bits]).tobytes()
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def test_resample_against_direct_sum():
    x = np.random.default_rng(0).normal(size=900).astype(np.float32)
    for source in (22_050, 8_000, 44_100, 16_000, 32_000):
        y = audio.resample(x, source)
        g = math.gcd(source, audio.RATE)
        up, down = audio.RATE // g, source // g
        assert len(y) == -(-len(x) * up // down)
        if up == down:
            continue
        # A Kaiser-windowed sinc around the exact place of each output, written down anew.
        cut = min(1.0, audio.RATE / source)
        half = math.ceil(audio.TAPS / 2 / cut)
        for n in range(0, len(y), 37):
            place = n * source / audio.RATE
            taps = {}
            for k in range(math.floor(place) - half + 1, math.floor(place) + half + 1):
                d = (k - place) * cut
                taps[k] = (math.sin(math.pi * d) / (math.pi * d) if abs(d) > 1e-12 else 1.0) * float(np.i0(8 * math.sqrt(max(0.0, 1 - ((k - place) / half) ** 2))))
            want = sum(v * x[k] for k, v in taps.items() if 0 <= k < len(x)) / sum(taps.values())
            assert y[n] == pytest.approx(want, abs=2e-4)
    long = np.random.default_rng(1).normal(size=120_000).astype(np.float32)
    assert np.allclose(audio.resample(long, 22_050)[:3000], audio.resample(long[:6000], 22_050)[:3000], atol=1e-5)


def test_tone_is_kept_and_alias_is_not():
    t = np.arange(44_100) / 44_100
    low, high = (audio.resample(np.sin(2 * np.pi * f * t).astype(np.float32), 44_100)[500:-500] for f in (1000, 12_000))
    assert np.sqrt((low**2).mean()) == pytest.approx(math.sqrt(0.5), rel=0.01) and np.sqrt((high**2).mean()) < 0.01


def test_log_mel_against_direct_transform():
    y = np.random.default_rng(2).normal(size=1000).astype(np.float32)
    mel, level = audio.log_mel(y)
    assert mel.shape == (7, audio.MELS)
    part = np.zeros(audio.FFT)
    part[: audio.FRAME] = y[3 * audio.HOP : 3 * audio.HOP + audio.FRAME] * audio._HANN
    k = np.arange(audio.FFT // 2 + 1)
    dft = (part[None, :] * np.exp(-2j * np.pi * k[:, None] * np.arange(audio.FFT) / audio.FFT)).sum(axis=1)
    assert np.allclose(mel[3], np.log(np.abs(dft) ** 2 @ audio.mel_bank() + audio.FLOOR), atol=1e-3)
    assert level[3] == pytest.approx(10 * math.log10((part[: audio.FRAME] ** 2).mean() + audio.FLOOR), abs=1e-3)


def test_segments_by_scan():
    rng = np.random.default_rng(4)
    for _ in range(50):
        level = np.repeat(rng.normal(0, 5, 30), 4)
        base, want, start, seen = np.median(level), [], None, False
        for i, v in enumerate([*level, -99.0]):
            if v >= base + audio.LOW_DB:
                start, seen = i if start is None else start, seen or v > base + audio.HIGH_DB
            elif start is not None:
                if seen and i - start >= audio.SHORTEST:
                    want.append((start, i))
                start, seen = None, False
        assert audio.segments(level) == want


def test_audio_tensors(spark, tmp_path):
    rate = 8000
    quiet, loud = np.random.default_rng(0).normal(0, 20, 3 * rate), np.random.default_rng(1).normal(0, 8000, rate)
    rows = [(1, wav(np.concatenate((quiet, loud, quiet)), rate)), (2, None), (3, b""), (4, b"RIFF\0\0\0\0WAVE"), (None, bytes(range(256)) * 10), (1, wav(quiet[:100], rate)), (5, wav(np.full(999, 128), 16_000, 8))]
    got = audio.audio_features(spark.createDataFrame(rows, "id long, audio binary"))
    rows = [r for r in got.collect() if r["id"] == 1 and r["end_s"] > 0.02]
    assert {r["id"] for r in got.collect()} == {1, None, 5} and [r["window"] for r in sorted(rows, key=lambda r: r["window"])] == list(range(len(rows)))
    spans = [(s["start_s"], s["end_s"]) for r in sorted(rows, key=lambda r: r["window"]) for s in r["segments"]]
    assert min(a for a, _ in spans) == pytest.approx(3, abs=0.05) and max(b for _, b in spans) == pytest.approx(4, abs=0.05)
    import pyarrow as pa

    one = pa.ipc.open_stream(rows[0]["tensor"]).read_all()
    assert one.schema.field("tensor").type == audio.TENSOR and one.num_rows == 1 and one["tensor"].chunk(0).to_numpy_ndarray().shape == (1, audio.WINDOW, audio.MELS)
    mel, _ = audio.log_mel(audio.resample(*audio.decode(wav(np.concatenate((quiet, loud, quiet)), rate))))
    first = min(rows, key=lambda r: r["window"])
    assert np.allclose(pa.ipc.open_stream(first["tensor"]).read_all()["tensor"].chunk(0).to_numpy_ndarray()[0], mel[: audio.WINDOW], atol=1e-4)
    t = audio.tensors(got.toArrow()["tensor"])
    assert t.to_numpy_ndarray().shape == (got.count(), audio.WINDOW, audio.MELS)
    written = audio.write_tensors(got, f"file://{tmp_path}/out").collect()
    back = [pa.ipc.open_file(r["file"]).read_all() for r in written]
    assert sum(x.num_rows for x in back) == got.count() and isinstance(back[0].schema.field("tensor").type, pa.FixedShapeTensorType)
    assert sorted(x for b in back for x in b["start_s"].to_pylist()) == sorted(r["start_s"] for r in got.collect())
    assert audio.audio_features(spark.createDataFrame([], "id long, audio binary")).count() == 0
    clash = spark.createDataFrame([("a", b"\x80" * 400_000, "own", "own")], "id string, audio binary, window string, tensor string")
    long = audio.audio_features(clash).collect()
    assert len(long) == -(-(-(-400_000 * 16_000 // 22_050) // audio.HOP) // audio.WINDOW) and {r["id"] for r in long} == {"a"}


# --- 4 decontamination


def brute_spans(doc, item, least=decontaminate.MIN_WORDS):
    out = []
    for i, j in itertools.product(range(len(doc)), range(len(item))):
        if doc[i] == item[j] and (i == 0 or j == 0 or doc[i - 1] != item[j - 1]):
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            if n >= least:
                out.append((i, j, n))
    return sorted(out)


def test_spans_against_brute_force(spark):
    rng = random.Random(5)
    items = [(k, sentence(rng, 40)) for k in range(6)] + [(None, sentence(rng, 20)), (7, None), (8, ""), (0, sentence(rng, 30))]
    rows = list(ODD)
    for i in range(40):
        parts = [sentence(rng, rng.randint(1, 20))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(len(w) - 5)
            parts += [" ".join(w[a : a + rng.randint(5, 25)]), sentence(rng, rng.randint(0, 9))]
        rows.append((100 + i, ", ".join(parts).upper() if i % 2 else " ".join(parts), "s"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for (i, t, _), (k, u) in itertools.product(rows, items):
        (h, at) = words.word_hashes([t, u])
        want += [(i, k, *s) for s in brute_spans(h[: at[1]].tolist(), h[at[1] :].tolist())] if t and u and len(t) < 10_000 else []
    want.sort(key=repr)
    assert len(want) > 20
    for limit in (decontaminate.BROADCAST_BYTES, -1):
        got = tuples(decontaminate.contaminated(docs_of(spark, rows), b, limit), "doc_id", "item_id", "doc_start", "item_start", "n_words")
        assert got == want
        kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs_of(spark, rows), b, limit).collect()}
        assert kept == {i for i, _, _ in rows} - {x[0] for x in want}
    assert decontaminate.contaminated(docs_of(spark, rows), b.limit(0)).count() == 0 and decontaminate.contaminated(docs_of(spark, rows).limit(0), b).count() == 0
    named = [df.withColumn(c, F.concat(F.lit("n"), c)) for df, c in ((docs_of(spark, rows), "doc_id"), (b, "item_id"))]
    for limit in (decontaminate.BROADCAST_BYTES, -1):
        assert tuples(decontaminate.contaminated(*named, limit), "doc_start", "item_start", "n_words") == sorted((x[2:] for x in want), key=repr)


# --- 5 near dedup


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(6)
    rows, groups = [], []
    for g in range(25):
        base = sentence(rng, 120).split()
        own = []
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = "zz" + str(rng.random())[2:6]
            own.append(len(rows))
            rows.append((len(rows), " ".join(w), "s"))
        groups.append(own)
    pairs = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if jaccard(rows[a][1], rows[b][1]) >= 0.65}
    root = {}
    for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect():
        root[r["doc_id"]] = r["duplicate_of"]
    of = lambda i: root.get(i, i)
    assert np.mean([of(a) == of(b) for a, b in pairs]) >= 0.97
    truth = {i: g[0] for g in groups for i in g}
    assert all(truth[i] == truth[r] for i, r in root.items())


def test_near_dedup_finds_each_pair_that_its_signatures_show(spark):
    """Against all pairs of signatures that agree in a band: the same groups, with string ids, copies and hot bands."""
    rng = random.Random(22)
    base = [sentence(rng, 60).split() for _ in range(4)]
    rows = []
    for k in range(160):
        w = list(base[k % 4])
        for _ in range(rng.randint(0, 9) if k % 3 else 0):
            w[rng.randrange(len(w))] = "zz" + str(rng.random())[2:5]
        rows.append((f"d{k:03}", " ".join(w)))
    sig = near_dedup.signatures([t for _, t in rows])
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = (np.frombuffer(sig[k]["sig"], np.uint8) for k in (i, j))
        if (sig[i]["bands"] == sig[j]["bands"]).any() and ((a == b).mean() - 1 / 256) / (1 - 1 / 256) >= 0.55:
            root[max(find(i), find(j))] = min(find(i), find(j))
    want = {rows[i][0]: rows[find(i)][0] for i in range(len(rows)) if find(i) != i}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r["doc_id"]: r["duplicate_of"] for r in got.collect()} == want and len(want) > 100


def test_signature_is_unbiased():
    rng = np.random.default_rng(7)
    got = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = near_dedup.min_max(x[:200]), near_dedup.min_max(x[100:])
        got.append((a == b).mean())
    assert np.mean(got) == pytest.approx(1 / 3, abs=0.02)


def test_drop_near_odd(spark):
    text = "one text that is long enough to be compared with others " * 3
    rows = [*ODD, (20, text, "a"), (21, text, "b"), (22, text + "tail", "b"), (20, text, "a"), (None, text, "a")]
    out = near_dedup.drop_near_duplicates(docs_of(spark, rows))
    got = tuples(out, "doc_id", "text")
    assert sum(r == (20, text) for r in got) == 1 and not any(i in (21, 22) for i, _ in got) and (None, text) in got
    assert {i for i, _, _ in ODD} <= {i for i, _ in got} and set(r["key"] for r in out.collect()) == {"own-key"}
    assert near_dedup.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


# --- 6 URLs


def test_url_trees_held_out(spark):
    rng = random.Random(8)

    def url(bad):
        host = "".join(rng.choice("abcdefgh") for _ in range(6)) + ("".join(rng.choice("0123456789") for _ in range(5)) if bad else "")
        query = "&".join(f"p{k}={rng.randrange(10**6)}" for k in range(rng.randint(3, 6) if bad else rng.randint(0, 2)))
        return f"http{'' if bad else 's'}://{host}.example.{rng.choice(['com', 'org'])}/a/{rng.randrange(99)}" + ("?" + query if query else "")

    data = [(url(b), b) for b in (rng.randrange(2) for _ in range(1500))]
    labelled = spark.createDataFrame(data[:1000] + [(None, None), ("x", None)], "url string, bad int")
    held = spark.createDataFrame([(i, u, "own") for i, (u, _) in enumerate(data[1000:])], "page_id long, url string, score string")
    p = {r["page_id"]: r["reject"] for r in url_filter.url_scores(held, labelled).collect()}
    assert np.mean([p[i] == bool(b) for i, (_, b) in enumerate(data[1000:])]) > 0.95 and url_filter.fit(labelled).auc > 0.95
    pages = spark.createDataFrame([("a", data[0][0]), (None, None), ("b", ""), ("b", "::::?&&#"), ("c", "http://h.example.com/" + "x" * 100_000)], "page_id string, url string")
    got = url_filter.url_scores(pages, labelled)
    assert got.count() == 5 and all(0 <= r["score"] <= 1 for r in got.collect())
    assert url_filter.url_scores(pages.limit(0), labelled).count() == 0
    assert {r["score"] for r in url_filter.url_scores(pages, labelled.limit(0)).collect()} == {1e-6}


def test_suffixes_are_counted_over_all_rows(spark):
    pages = spark.createDataFrame([(i, f"http://a{i}.{'bad.com' if i % 3 else 'ok.org'}/x") for i in range(60)], "page_id long, url string")
    labelled = pages.where("page_id < 30").select("url", (F.col("page_id") % 2).cast("int").alias("bad"))
    rows, prior = url_filter.with_suffixes(pages, pages, labelled)
    assert prior == 0.5 and tuples(rows.select("page_id", "__tw_n", "__tw_l", "__tw_b")) == sorted(((i, 40, 20, 10) if i % 3 else (i, 20, 10, 5) for i in range(60)), key=repr)


def test_first_tree_against_brute_force():
    """The root of the first tree is the split of highest gain among all features and limits, and each leaf the Newton step of its rows."""
    rng = np.random.default_rng(21)
    x = rng.integers(0, 12, (300, 16)).astype(float)
    y = (x[:, 3] + rng.normal(0, 2, 300) > 6).astype(float)
    f, limit, leaf, base = url_filter.boost(x, y, 1)
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))

    def gain(rows, feature, cut):
        parts = [rows & (x[:, feature] <= cut), rows & (x[:, feature] > cut)]
        if min(q.sum() for q in parts) < url_filter.LEAF:
            return -np.inf
        return sum(g[q].sum() ** 2 / (h[q].sum() + url_filter.RIDGE) for q in parts) - g[rows].sum() ** 2 / (h[rows].sum() + url_filter.RIDGE)

    cuts = [(k, c) for k in range(16) for c in np.unique(np.quantile(x[:, k], np.linspace(0, 1, url_filter.BINS + 1)[1:-1]))]
    whole = np.ones(300, bool)
    best = max(cuts, key=lambda c: gain(whole, *c))
    assert gain(whole, f[0, 0], limit[0, 0]) == pytest.approx(gain(whole, *best))
    left = whole & (x[:, f[0, 0]] <= limit[0, 0])
    assert gain(left, f[0, 1], limit[0, 1]) == pytest.approx(max(gain(left, *c) for c in cuts))
    node = np.zeros(300, np.int64)
    for _ in range(url_filter.DEPTH):
        node = 2 * node + 1 + (x[np.arange(300), f[0, node]] > limit[0, node])
    at = node - (2**url_filter.DEPTH - 1)
    for k in np.unique(at):
        assert leaf[0, k] == pytest.approx(url_filter.RATE * g[at == k].sum() / (h[at == k].sum() + url_filter.RIDGE))


def test_boosting_lowers_the_loss():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(800, 16))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    f, limit, leaf, base = url_filter.boost(x, y)
    raw = url_filter.Trees(f, limit, leaf, base).raw(x)
    assert ((raw > 0) == (y > 0)).mean() > 0.95
    assert url_filter.auc(np.array([0.1, 0.4, 0.4, 0.8]), np.array([0, 0, 1, 1.0])) == 0.875


# --- 7 sharding


def test_shards_against_sql(spark):
    con = connect("/root/testdata/sf0.01")
    assert difference(registry.queries()["op7_sharding"](spark, "/root/testdata/sf0.01"), con, registry.oracle_sql()["op7_sharding"]) is None


def test_shards_hold_the_mixture(spark, tmp_path):
    rows = [(i, f"t{i}", "hot" if i % 10 < 7 else None if i % 10 == 7 else f"s{i % 3}") for i in range(1000)]
    df = docs_of(spark, rows)
    got = sharding.shards(df, 100, bucket_rows=64).collect()
    assert len(got) == 1000 and sorted({r["shard"] for r in got}) == list(range(10))
    for k in range(10):
        own = [r for r in got if r["shard"] == k]
        assert sorted(r["place"] for r in own) == list(range(100)) and abs(sum(r["source"] == "hot" for r in own) - 70) <= 2
    assert tuples(sharding.shards(df, 100, bucket_rows=10**9), "doc_id", "shard", "place") == tuples(sharding.shards(df, 100, bucket_rows=64), "doc_id", "shard", "place")
    assert sharding.shards(docs_of(spark, ODD), 3).count() == len(ODD) and sharding.shards(df.limit(0)).count() == 0
    sharding.write_shards(df, str(tmp_path / "s"), 100, bucket_rows=64)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("shard_").count().where("count = 100").count() == 10 and tuples(back.select(*df.columns)) == tuples(df)


def test_written_shards_keep_repeats(spark, tmp_path):
    rows = [(1, "a", "s"), (1, "a", "s"), (1, "b", "s"), (None, "c", "s"), (None, "c", None), (None, "d", "s"), (2, None, "s")]
    df = docs_of(spark, rows * 3, extra=False)
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    assert tuples(spark.read.parquet(str(tmp_path / "s")).select(*df.columns)) == tuples(df)


# --- 8 tokens


def test_tokens_against_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    rank = token_counts.ranks(token_counts.VOCABULARY)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=rank, special_tokens={})
    texts = [r["text"] for r in table(spark, SMALL, "documents").collect()] + ["", " a  b\n\n c ", "don't I'll", "日本語 🎉🎉", "x" * 5000, "<|endoftext|>", "ab" * 3000 + " " * 70 + "\n"]
    got = token_counts.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] is not None} == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert next(r for r in got if r["doc_id"] is None)["n_tokens"] == 0 and sum(r["n_whole"] for r in got) > 0
    v = token_counts.vocabulary()
    counting, plain = token_counts.Counting(v), token_counts.Counting(dataclasses.replace(v, whole=frozenset()))
    assert [counting.count(t)[0] for t in texts] == [plain.count(t)[0] for t in texts]
    for w in random.Random(0).sample(sorted(token_counts.proved(token_counts.VOCABULARY)), 300):
        assert len(enc._encode_single_piece(w)) == 1
    for t in ("ab" * 40, "%" * 200, "é" * 90):
        assert token_counts._merge_long(t.encode(), rank) == _plain_merge(t.encode(), rank)


def test_chunks_hold_whole_pretokens():
    """Counting by chunks is counting by the pattern over the whole text, whatever white space there is; so is it when a worker forgets."""
    import regex

    rng, pattern = random.Random(17), regex.compile(token_counts.PATTERN)
    v = token_counts.vocabulary()
    counting = token_counts.Counting(v)
    texts = []
    for _ in range(3000):
        text = "".join(rng.choice(["a", "the", "Ärger,", "x.", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x1f ", "\u2028", "\xa0", "\x85", "'s", "'", "12", "é", "!?", "日本", "\u3000", "\u200b"]) for _ in range(rng.randint(0, 14)))
        pieces = pattern.findall(text)
        assert counting.count(text) == (sum(len(token_counts.merge(p.encode(), v.rank)) for p in pieces), len(pieces), sum(p in v.whole for p in pieces)), repr(text)
        texts.append(text)
    import pyarrow as pa

    assert [tuple(r) for r in counting.counts(pa.array([*texts, None, "", " "]).slice(1)).tolist()] == [counting.count(t) for t in [*texts[1:], None, "", " "]]
    assert [c for c in map(chr, range(0x11000)) if bool(regex.match(r"\s", c)) != (c.isspace() and c not in token_counts._SEPARATORS)] == []
    counting.chunks = dict.fromkeys(map(str, range(token_counts._REMEMBERED)), -1)
    assert counting.count("forgetting nothing") == token_counts.Counting(v).count("forgetting nothing") and len(counting.chunks) == 2
    pieces = [bytes(rng.choice(b"theandoin \xc3\xa9\xe6\x97\xa5!?0") for _ in range(rng.randint(1, 90))) for _ in range(2000)]
    assert token_counts.merged_sizes(pieces, v).tolist() == [len(token_counts.merge(p, v.rank)) for p in pieces] and len(token_counts.merged_sizes([], v)) == 0


def test_token_counts_odd(spark):
    df = docs_of(spark, ODD)
    got = token_counts.token_counts(df).collect()
    assert len(got) == len(ODD) and sum(r["n_tokens"] == 0 for r in got) == 3 and len({(r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] == 4}) == 1
    assert token_counts.token_counts(df.limit(0)).count() == 0
    assert {r["doc_id"] for r in token_counts.token_counts(df.withColumn("doc_id", F.concat(F.lit("d-"), "doc_id"))).collect()} == {None, "d-1", "d-2", "d-3", "d-4", "d-5"}


def _plain_merge(piece, rank):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


# --- 9 toxicity


def brute_kernel(a, b):
    def phi(s):
        c = [-1, *map(ord, s), -2]
        out = {}
        for i, j, k in itertools.combinations(range(len(c)), 3):
            if k - i < toxicity.SPAN:
                u = (c[i], c[j], c[k])
                out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_kernel_and_folding_against_brute_force():
    units = ["idiot", "idiiot", "ixdiot", "banana", "ananas", "a", "straße", "thththth", "日本"]
    marks = toxicity.Landmarks(units[:5])
    want = np.array([[brute_kernel(u, m) for m in units[:5]] for u in units])
    assert np.allclose(marks.kernel(units), want, atol=1e-5)
    alpha = np.array([1.0, -0.5, 0.3, 0.2, -1])
    assert np.allclose(toxicity.against(units, marks.folded(alpha)), want @ alpha, atol=1e-5)
    exact, some = toxicity.against(units, marks.folded(alpha)), toxicity.against(units, marks.folded(alpha), 0.4)
    assert ((exact > 0.4) == (some > 0.4)).all() and np.allclose(some[exact > 0.4], exact[exact > 0.4])


def toxic_rows(rng, n, start=0):
    rows, labels = [], []
    for i in range(start, start + n):
        bad = rng.random() < 0.3
        ws = sentence(rng, 30).split()
        if bad:
            ws.insert(rng.randrange(len(ws)), rng.choice(["moron", "stupid", "wretch"]))
        rows.append((i, " ".join(ws), "s"))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def machine(spark):
    rows, labels = toxic_rows(random.Random(10), 400)
    return toxicity.fit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_held_out(spark, machine):
    rows, labels = toxic_rows(random.Random(11), 300, 1000)
    gone = {r["doc_id"] for r in toxicity.toxic_documents(docs_of(spark, rows), None, machine).collect()}
    assert np.mean([(i in gone) == bool(v) for i, v in labels]) >= 0.98
    hidden = docs_of(spark, [(1, "you st-upid one", "a"), (2, "what a s t u p i d thing", "a"), (3, "that w.r.e.t.c.h again", "a"), (4, "abba baba habe", "a")])
    assert {r["doc_id"] for r in toxicity.toxic_documents(hidden, None, machine).collect()} == {1, 2, 3}


def test_letters_of_other_scripts_are_told_apart():
    for mark, others in (("дурак", ("книга", "школа", "город", "человек", "время")), ("ηλίθιος", ("θάλασσα", "βιβλίο", "ουρανός")), ("笨蛋傻瓜", ("学校老师", "今天天气"))):
        got = toxicity.Landmarks([mark]).kernel([mark, *others])[:, 0]
        assert got[0] == pytest.approx(1) and got[1:].max() < 0.15


def test_two_words_together_and_wrong_labels(spark):
    """An insult of two harmless words is learned, and one label in twenty may be wrong."""
    rng = random.Random(18)
    rows, labels = toxic_rows(rng, 500)
    rows = [(i, t.replace("moron", "gone mad").replace("wretch", "gone mad"), s) for i, t, s in rows]
    for k in range(0, 500, 7):
        i, t, s = rows[k]
        rows[k] = (i, t + " gone abc" if k % 2 else t + " abc mad", s)
    noisy = [(i, 1 - v if rng.random() < 0.05 else v) for i, v in labels]
    m = toxicity.fit(docs_of(spark, rows), spark.createDataFrame(noisy, "doc_id long, toxic int"))
    rows, labels = toxic_rows(random.Random(19), 200, 1000)
    rows = [(i, t.replace("moron", "gone mad").replace("wretch", "gone, mad!"), s) for i, t, s in rows]
    gone = {r["doc_id"] for r in toxicity.toxic_documents(docs_of(spark, rows), None, m).collect()}
    assert "gone mad" in m.pairs and np.mean([(i in gone) == bool(v) for i, v in labels]) >= 0.97
    assert not toxicity.toxic_documents(docs_of(spark, [(1, "he had gone abc and she was mad", "s")]), None, m).collect()


def test_squared_hinge_against_descent():
    rng = np.random.default_rng(20)
    z = np.concatenate((rng.normal(size=(150, 4)), np.ones((150, 1))), axis=1)
    y, c = np.where(z[:, 0] + rng.normal(size=150) > 0, 1.0, -1.0), rng.uniform(0.5, 2, 150)
    ridge = np.array([1, 1, 1, 1, 1e-6])
    w = np.zeros(5)
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (z @ w))
        w -= 1e-3 * (ridge * w - z.T @ (c * y * slack))
    assert np.allclose(toxicity._squared_hinge(z, y, c), w, atol=1e-3)


def test_toxicity_odd(spark, machine):
    df = docs_of(spark, [*ODD, (9, "word " * 30_000 + "stupid", "a"), (None, "stupid", None)])
    got = toxicity.toxic_documents(df, None, machine)
    assert tuples(got, "doc_id") == [(9,), (None,)]
    kept = toxicity.drop_toxic(df, None, machine)
    assert kept.count() == len(ODD) and kept.columns == df.columns and {r["score"] for r in kept.collect()} == {"own-score"}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxic_documents(df, none).count() == 0 and toxicity.toxic_documents(df.limit(0), none).count() == 0
    some = spark.createDataFrame([("d-9", 1), ("d-9", 1), ("d-5", 0), (None, 1), ("d-4", None)], "doc_id string, toxic int")
    named = df.withColumn("doc_id", F.concat(F.lit("d-"), "doc_id"))
    assert toxicity.drop_toxic(named, some).count() <= named.count()


# --- 10 packing


def brute_ffd(lengths, capacity):
    room, out = [], []
    for n in lengths:
        k = next((i for i, r in enumerate(room) if r >= n), None)
        if k is None:
            k = len(room)
            room.append(capacity)
        room[k] -= n
        out.append(k)
    return out


def test_packing_against_brute_force(spark):
    rng = random.Random(12)
    for _ in range(200):
        lengths = sorted((rng.randint(1, 50) for _ in range(rng.randint(0, 60))), reverse=True)
        assert packing.first_fit_decreasing(lengths, 50) == brute_ffd(lengths, 50)
    rows = [(i if i % 7 else None, "w" * rng.randint(0, 900), "s") for i in range(300)] + ODD
    got = packing.pack(docs_of(spark, rows), capacity=100, group_docs=50).collect()
    assert len({r["group_id"] for r in got}) > 1 and all(r["used"] == sum(r["lengths"]) <= 100 for r in got)
    tokens = {}
    for r in got:
        for i, n in zip(r["doc_ids"], r["lengths"], strict=True):
            tokens[i] = tokens.get(i, 0) + n
    want = {}
    for i, t, _ in rows:
        if t:
            want[i] = want.get(i, 0) + -(-len(t.encode()) // 4)
    assert tokens == want and packing.pack(docs_of(spark, rows).limit(0)).count() == 0
    named = packing.pack(docs_of(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), capacity=100).collect()
    assert sum(r["used"] for r in named) == sum(want.values()) and "d1" in {i for r in named for i in r["doc_ids"]}
    for g in {r["group_id"] for r in got}:
        own = sorted((n for r in got if r["group_id"] == g for n in r["lengths"]), reverse=True)
        bins = brute_ffd(own, 100)
        assert max(bins) + 1 == sum(r["group_id"] == g for r in got)


@pytest.mark.parametrize("packed", [lambda spark, d: registry.queries()["op10_packing"](spark, d), lambda spark, d: corpus_pipeline.STAGES[-1][1](spark, table(spark, d, "documents"), d)])
def test_packing_holds_whole_tokens(spark, tmp_path, packed):
    """Each document's pieces join to its true tokens, and no sequence holds more than its capacity of them."""
    odd = [(-1, "日本語 🎉🎉 " * 1500, "s"), (-2, "", "s"), (-3, None, "s"), (-4, "é" * 9000, "s")]
    docs = table(spark, SMALL, "documents").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string, s string").drop("s"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counting = token_counts.Counting(dataclasses.replace(token_counts.vocabulary(), whole=frozenset()))
    want = {r["doc_id"]: n for r in docs.collect() if (n := counting.count(r["text"])[0])}
    pieces = {}
    for r in packed(spark, str(tmp_path)).collect():
        assert r["used"] == sum(r["lengths"]) <= packing.CAPACITY
        for i, start, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True):
            pieces.setdefault(i, []).append((start, n))
    assert {i: sum(n for _, n in x) for i, x in pieces.items()} == want and max(map(len, pieces.values())) > 1
    for x in map(sorted, pieces.values()):
        assert [start for start, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))]


# --- registry and pipeline


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs_over_its_table(spark, name):
    df = registry.queries()[name](spark, SMALL)
    rows = df.collect()
    whole = {"op2_quality": "documents", "op6_url_filter": "pages", "op7_sharding": "documents", "op8_token_counts": "documents"}
    if name in whole:
        assert len(rows) == table(spark, SMALL, whole[name]).count()


def test_pipeline_stages_against_brute_force(spark):
    """A small corpus through all stages, each decision made by hand."""
    rng = random.Random(13)
    shared = sentence(rng, 20)
    clean = [sentence(rng, 60) for _ in range(6)]
    rows, labels = toxic_rows(random.Random(10), 400, 10_000)
    rows += [(1, clean[0], "s"), (2, clean[0], "s"), (3, clean[1] + "\n" + shared, "s"), (4, clean[2] + "\n" + shared, "s"), (5, clean[3] + " stupid", "s"), (6, "so it begins " + " ".join(clean[4].split()[:40]), "s"), (7, None, "s")]
    docs = docs_of(spark, rows, extra=False)
    bench = spark.createDataFrame([(1, " ".join(clean[4].split()[5:30]))], "item_id long, text string")
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        docs.write.parquet(f"{d}/documents.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        now, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, d).write.parquet(f"{d}/{name}")
            now = spark.read.parquet(f"{d}/{name}")
            seen[name] = now
        ids = lambda n: {r["doc_id"] for r in seen[n].collect() if r["doc_id"] < 10_000}
        assert ids("toxicity") == {1, 2, 3, 4, 6, 7}
        assert ids("line_dedup") == {1, 3, 4, 6, 7}
        text = {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()}
        assert text[3].endswith(shared) and text[4] == clean[2]
        assert ids("minhash_near_dedup") == {1, 3, 4, 6, 7} and ids("decontamination") == {1, 3, 4, 7}
        assert seen["decontamination"].columns == docs.columns
        packed = {i for r in seen["packing"].collect() for i in r["doc_ids"]}
        assert {i for i in packed if i < 10_000} == {1, 3, 4}
        assert tuples(corpus_pipeline.run(spark, d), "group_id", "bin", "used") == tuples(seen["packing"], "group_id", "bin", "used")


@pytest.mark.parametrize("kind", ["clashes", "empty"])
def test_pipeline_on_odd_documents(spark, tmp_path, kind):
    """Null ids, empty and repeated texts, and columns named as the operators' own; and no documents, labels or benchmark at all."""
    df = docs_of(spark, [*ODD, (7, "a line that stands in two documents, word by word\nmore", "s"), (8, "a line that stands in two documents, word by word", "s")])
    df = df.limit(0) if kind == "empty" else df
    spark.createDataFrame([] if kind == "empty" else [(None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if kind == "empty" else [(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = df
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == df.columns
            own = {r["key"] for r in now.collect()}
            assert own == (set() if kind == "empty" else {"own-key"})
            ids = {r["doc_id"] for r in now.collect()}
            assert kind == "empty" or ids == ({None, 1, 2, 3, 4, 5, 7, 8} if name == "toxicity" else {None, 1, 2, 3, 4, 5, 7})
    packed = {i for r in now.collect() for i in r["doc_ids"]}
    assert packed == (set() if kind == "empty" else {None, 3, 4, 5, 7})


def test_line_postings_meet_alike_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    lines = [" ".join(rng.choice(words, 12)) for _ in range(300)]
    lines += [x[:20] + "#" + x[20:] for x in lines]
    blobs = list(line_dedup._post(2, 1)([pa.record_batch([pa.array(["\n".join(lines)])], names=["text"])]))
    table = pa.Table.from_batches(blobs).sort_by("pid").combine_chunks()

    def met(most: int) -> set:
        monkeypatch.setattr(line_dedup, "_SLICE", most)
        return {r for b in line_dedup._meet(iter(table.to_batches())) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}

    assert met(100) == met(10**9) != set()
    assert list(line_dedup._meet(iter([]))) == []


def test_names_tell_chance_meetings_from_near_lines():
    """Lines that share a segment and their length, but not their letters, end where they meet; near ones never do."""
    rng = random.Random(18)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    near = lambda a, b: line_dedup._near(*np.split(line_dedup._names([a, b], np.array([line_dedup.line_hash(x) for x in (a, b)], np.uint64)), 2))[0]
    for k in range(300):
        a = letters(rng.randint(30, 700), "abcdefgh é")
        b = changed(rng, a, int(line_dedup.limit(len(a))))
        if a != b and line_dedup.edit_distance(a, b, int(line_dedup.limit(min(len(a), len(b))))) is not None:
            assert near(a, b) and near(b, a)
    head = "a segment that both share"
    assert not any(near(head + letters(60, "aeiou"), head + letters(60, "bcdfg")) for _ in range(50))


def test_hot_groups_hand_few_pairs_of_lines(spark):
    """A line is compared in its own class, and in the one before only where that may hold a shorter near copy."""
    lines = ["x" * n for n in (20, 22, 23, 29, 300, 320, 340)]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(F.char_length("line").alias("n"), line_dedup._compared(F.char_length("line")).alias("c"))
    assert {r["n"]: r["c"] for r in got.collect()} == {20: [0], 22: [1, 0], 23: [1], 29: [1], 300: [11], 320: [12, 11], 340: [12]}


def test_written_leaves_no_shuffle_files(spark):
    import time

    from tidewell.session import written

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in str(disk.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in x}
    before = files()
    written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left


def test_url_labels_are_made_once(spark):
    """Labels may come from whole pages; a null page has none."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def bad(n):
        made.add(1)
        return n % 2

    pages = spark.createDataFrame([(k, f"https://a{k % 7}.example/{k}") for k in range(80)], "page_id long, url string")
    assert url_filter.url_scores(pages, pages.select("url", bad("page_id").alias("bad"))).count() == 80 and made.value == 80
    html = spark.createDataFrame([(0, None), (1, "<p>fine words</p>"), (2, "<script>!! ### !!</script>plain"), (3, "<b>go!! now!!</b> ###"), (4, "")], "k int, html string")
    assert dict(html.select("k", url_filter.junk_page()).collect()) == {0: None, 1: 0, 2: 0, 3: 1, 4: 0}


def test_tokens_alone_are_those_of_all_counts(tmp_path):
    """Packing asks for tokens alone; texts with white space of every kind go the slow way."""
    import base64

    strings = [bytes([k]) for k in range(256)] + [b"ab", b" a", b" ab", b"abc"]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(x) + b" %d\n" % k for k, x in enumerate(strings)))
    counting = token_counts.Counting(token_counts.vocabulary(str(tmp_path / "v")))
    texts = pa.array(["ab abc, cab", "", None, "  a \x1c b\n", " ab", "abc" * 40])
    every, alone = counting.counts(texts), counting.counts(texts, 1)
    assert every.shape == (6, 3) and (every[:, :1] == alone).all() and every[:, 0].tolist()[1:3] == [0, 0]
    assert [counting.count(x.as_py()) for x in texts] == [tuple(r) for r in every.tolist()]


def test_merging_many_pieces_takes_bounded_memory():
    """Distinct pieces of a batch are merged part by part; what a worker remembers is bounded, and counts don't depend on it."""
    import tracemalloc

    v = token_counts.vocabulary()
    rng = random.Random(21)
    pieces = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(60_000)]
    tracemalloc.start()
    sizes = token_counts.merged_sizes([p.encode() for p in pieces], v)
    most = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert most < 40 and sizes[-5:].tolist() == [len(token_counts.merge(p.encode(), v.rank)) for p in pieces[-5:]]


def test_forgetting_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(token_counts, "_REMEMBERED", 100)
    v = token_counts.vocabulary()
    counting, plain = token_counts.Counting(v), token_counts.Counting(v)
    for k in range(40):
        chunks = [" qzxcommon", *(f" q{k}z{i}" for i in range(60))]
        assert counting.packed(chunks) == plain.packed(chunks)
        assert " qzxcommon" in {**counting.old, **counting.chunks} and len(counting.chunks) + len(counting.old) < 1000


def test_segments_count_from_the_nearer_end():
    """Fewer postings a line, each name in fewer bytes, hot keys together in few batches."""
    rng = random.Random(22)
    lines = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(280, 330))) for _ in range(200)]
    assert len(line_dedup.entries(lines)[0]) < 20 * len(lines)
    blobs = list(line_dedup._post(3, 1)(iter([pa.record_batch([pa.array(lines)], ["line"])])))
    size = sum(len(x) for b in blobs for x in b.column(1).to_pylist()) // 4
    assert sum(len(x) for b in blobs for x in b.column(2).to_pylist()) <= 8.5 * size + 8 * len(blobs)
    names = np.sort(np.array([rng.getrandbits(64) for _ in range(1001)], np.uint64))
    assert (line_dedup._unpacked(np.frombuffer(line_dedup._packed(names), np.uint8), len(names)) == names).all()
    heads = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(100)) for _ in range(30)]
    hot = [h + "".join(rng.choice("abcdefghijklmnop ") for _ in range(60)) for h in heads for _ in range(40)]
    blobs = pa.Table.from_batches(list(line_dedup._post(1, 1)(iter([pa.record_batch([pa.array(hot)], ["line"])])))).sort_by("pid").combine_chunks()
    met = [b for b in line_dedup._meet(iter(blobs.to_batches())) if b.num_rows and b.column(0)[0].as_py()]
    assert len({x for b in met for x in b.column(0).to_pylist()}) >= 30 and len(met) < 5


def test_keys_meet_in_rounds(spark, tmp_path, monkeypatch):
    """Each round posts about half of the keys, all rounds post every key once, and they find the same lines, be the lengths mixed or all of one class."""
    rng = random.Random(23)
    posted, post = [], line_dedup._post
    monkeypatch.setattr(line_dedup, "_post", lambda parts, level, *where: posted.append((level, *where)) or post(parts, level, *where))
    for name, words in (("mixed", range(3, 40)), ("one", [12])):
        base = [sentence(rng, rng.choice(words)) for _ in range(60)]
        if name == "one":
            base = [x.ljust(70, "k")[:70] for x in base]
        rows = [(i, "\n".join(changed(rng, rng.choice(base), 2) for _ in range(4)), "s") for i in range(80)]
        docs_of(spark, rows).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        monkeypatch.setattr(line_dedup, "ONE_ROUND", 0)
        posted.clear()
        got = tuples(line_dedup.duplicate_lines(docs), "doc_id", "line_no", "dup_doc_id", "dup_line_no", "distance")
        far = lambda a, b: 10**6 if (d := line_dedup.edit_distance(a, b, int(line_dedup.limit(min(len(a), len(b)))))) is None else d
        assert got == brute_lines(rows, far) and len(got) > 100
        rounds = [x for x in posted if x[0] == 1]
        assert len(rounds) == line_dedup.ROUNDS and len({start for _, _, start in rounds}) == len(rounds)
        lines = sorted({x.strip(" ") for _, t, _ in rows for x in t.split("\n")})
        keys = lambda *span: list(zip(*(x.tolist() for x in line_dedup.entries(lines, 1, *span)), strict=True))
        parts = [keys(span) for _, span, _ in rounds]
        assert sorted(x for p in parts for x in p) == sorted(keys()) and max(map(len, parts)) < 0.65 * len(keys())
        for (_, span, _), part in zip(rounds, parts, strict=True):
            low, beyond = line_dedup._lengths(span)
            assert all(low <= len(lines[i]) < beyond for i, _, _ in part)
