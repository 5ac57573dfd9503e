"""Quality of one stream of samples against another: against a plain version over whole signals, and by what it must do."""

import math
import random

import numpy as np
import pytest

from packetloom.operators import comparison as cmp


def stereo(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        v = 5000 * math.sin(2 * math.pi * 440 * i / 48000) + 2500 * math.sin(2 * math.pi * 3100 * i / 48000)
        out += [int(v) + r.randint(-300, 300), int(v / 2) + r.randint(-300, 300)]
    return out


def noisy(samples, amount, seed=9):
    r = random.Random(seed)
    return [max(-32768, min(32767, s + round(amount * r.uniform(-1, 1)))) for s in samples]


def by_hand(ref, test, channels, rate):
    """Frame by frame over whole signals, each place of a spectrum by its sum."""
    x = np.array(ref[: len(ref) // 2 * 2], float).reshape(-1, 2)
    x = x if channels == 2 else x.mean(axis=1, keepdims=True)
    y = np.array(test, float)[: len(test) // channels * channels].reshape(-1, channels)
    ratio, n = 48000 // rate, cmp.BANDS[rate]
    frames = (len(x) - 480 + 120) // 120

    def power(signal, size, step, scale, places):
        window = 0.5 - 0.5 * np.cos(2 * np.pi / (size - 1) * np.arange(size))
        turn = np.exp(-2j * np.pi * np.outer(np.arange(places), np.arange(size)) / size)
        return np.array([[abs(scale * (turn @ (window * signal[t * step : t * step + size, c]))) ** 2 + 100000 for c in range(channels)] for t in range(frames)]).transpose(0, 2, 1)

    xs, ys = power(x, 480, 120, 1, 200), power(y, 480 // ratio, 120 // ratio, ratio, cmp.EDGES[n])
    energy = np.array([[[xs[t, a:b, c].mean() for c in range(channels)] for a, b in zip(cmp.EDGES, cmp.EDGES[1:], strict=False)] for t in range(frames)])
    total = 0.0
    for t in range(frames):
        for b in range(1, 21):
            energy[t, b] += 0.1 * energy[t, b - 1]
        for b in range(19, -1, -1):
            energy[t, b] += 0.03 * energy[t, b + 1]
        if t:
            energy[t] += 0.5 * energy[t - 1]
        if channels == 2:
            energy[t] = energy[t] + 0.01 * energy[t][:, ::-1].copy()
    for b in range(n):
        for j in range(cmp.EDGES[b], cmp.EDGES[b + 1]):
            xs[:, j] += 0.1 * energy[:, b]
            ys[:, j] += 0.1 * energy[:, b]
    most = {48000: 200, 12000: cmp.EDGES[n]}.get(rate, cmp.EDGES[n] - 3)
    for t in range(frames):
        ef = 0.0
        for b in range(n):
            eb = 0.0
            for j in range(cmp.EDGES[b], min(cmp.EDGES[b + 1], most)):
                for c in range(channels):
                    share = (ys[t, j, c] + (ys[t - 1, j, c] if t else 0)) / (xs[t, j, c] + (xs[t - 1, j, c] if t else 0))
                    eb += (share - math.log(share) - 1) * (0.1 if 79 <= j <= 81 else 1) * (0.1 if j == 80 else 1)
            ef += (eb / ((cmp.EDGES[b + 1] - cmp.EDGES[b]) * channels)) ** 2
        total += (ef / 21) ** 4
    e = (total / frames) ** (1 / 16)
    return frames, e, 100 * (1 - 0.5 * math.log(1 + e) / math.log(1.13))


def blocks(spark, signals, channels, size):
    """Signals by name, cut into blocks of `size` samples a channel, in no order."""
    rows = [(name, at, s[at * channels : (at + size) * channels]) for name, s in signals.items() for at in range(0, max(1, -(-len(s) // channels)), size)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "stream string, position long, samples array<int>")


def compared(spark, refs, tests, channels=2, rate=48000, size=700):
    out = cmp.compare(blocks(spark, refs, 2, size), blocks(spark, tests, channels, size), channels=channels, rate=rate)
    return {r.stream: r for r in out.collect()}


@pytest.mark.parametrize(("channels", "rate"), [(2, 48000), (1, 48000), (1, 16000), (2, 12000), (2, 24000), (1, 8000)])
def test_against_a_plain_version(spark, channels, rate, monkeypatch):
    monkeypatch.setattr(cmp, "RUN", 40)  # several runs for each stream; warm-up covers all that came before
    refs = {name: stereo(n, k) for k, (name, n) in enumerate([("a", 12_000), ("b", 9_600), ("c", 480)])}
    ratio, tests = 48000 // rate, {}
    for name, s in refs.items():
        frames = [s[2 * i : 2 * i + 2] if channels == 2 else [(s[2 * i] + s[2 * i + 1]) // 2] for i in range(0, len(s) // 2, ratio)]
        tests[name] = noisy([v for f in frames for v in f], 200)
    refs["a"].append(7)  # an odd sample is left out
    got = compared(spark, refs, tests, channels, rate)
    for name in refs:
        frames, e, q = by_hand(refs[name], tests[name], channels, rate)
        r = got[name]
        assert (r.n_frames, r.error, r.passed) == (frames, None, q >= 0)
        assert r.weighted_error == pytest.approx(e, rel=1e-9) and r.quality == pytest.approx(q, rel=1e-9)


def test_what_it_must_do(spark):
    ref = stereo(4800, 1)
    amounts = [0, 20, 60, 150, 400, 1000]
    refs = {str(a): ref for a in amounts} | {"silent": ref}
    tests = {str(a): noisy(ref, a) for a in amounts} | {"silent": [0] * len(ref)}
    got = compared(spark, refs, tests)
    found = [got[str(a)].quality for a in amounts]
    assert found[0] == 100 and got["0"].weighted_error == 0 and got["0"].n_frames == 37
    assert found == sorted(found, reverse=True) and found[-1] < found[1] and got["20"].passed and found[1] < 100
    assert got["silent"].quality < 0 and not got["silent"].passed


def test_errors_have_names(spark):
    a = stereo(1000, 2)
    refs = {"short": a[:800], "match": a, "fewer": a, "only": a, "none": [], "empty both": []}
    tests = {"short": a[:800], "match": a, "fewer": a[:1800], "extra": a, "none": a, "empty both": []}
    got = compared(spark, refs, tests)
    assert {n: r.error for n, r in got.items()} == {
        "short": "insufficient sample data", "match": None, "fewer": "sample counts do not match", "only": "sample counts do not match", "extra": "sample counts do not match",
        "none": "sample counts do not match", "empty both": "insufficient sample data",
    }
    assert all(r.quality is None and r.passed is None for r in got.values() if r.error)
    rows = [("gap", 0, a[:1000]), ("gap", 501, a[1000:]), ("twice", 0, a), ("twice", 0, a), (None, 0, a)]
    df = spark.createDataFrame(rows, "stream string, position long, samples array<int>")
    assert {r.stream: r.error for r in cmp.compare(df, df).collect()} == {"gap": "blocks overlap or leave gaps", "twice": "blocks overlap or leave gaps", None: None}
    for kinds in ({"rate": 44100}, {"channels": 3}):
        with pytest.raises(ValueError):
            cmp.compare(df, df, **kinds)
    assert cmp.compare(df.where("false"), df.where("false")).collect() == []


def test_runs_need_only_what_leads_in(spark):
    """Runs of the size in use give the same as one run over everything."""
    x = np.array(stereo(120 * 1300, 3), float).reshape(-1, 2)
    y = np.array(noisy(x.ravel().tolist(), 300), float).reshape(-1, 2)
    whole = cmp.frame_errors(x, y, 48000, 0)
    k = 2
    first = k * cmp.RUN - cmp.WARM_UP
    n = len(whole) - first
    part = cmp.frame_errors(x[first * 120 :][: (n - 1) * 120 + 480], y[first * 120 :][: (n - 1) * 120 + 480], 48000, cmp.WARM_UP)
    assert np.allclose(part, whole[k * cmp.RUN :], rtol=1e-12)


def test_the_query_over_documents(spark):
    from packetloom.plans import registry

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in registry.queries()["stream_quality"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    checked = 0
    for i, t in docs.items():
        data = t.encode()
        x = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(int).tolist()
        y = [v - v % 2 ** (i % 13) for v in x] if i % 2 == 0 else [int((x[6 * k] + x[6 * k + 1]) / 2) for k in range(len(x) // 6)]
        n, ratio = len(x) // 2, 1 if i % 2 == 0 else 3
        error = "sample counts do not match" if n != (len(y) // (2 if i % 2 == 0 else 1)) * ratio else "insufficient sample data" if n < 480 else None
        assert got[i].error == error and (got[i].quality is None) == (error is not None)
        if error is None and n < 4000:
            frames, _, q = by_hand(x, y, 2 if i % 2 == 0 else 1, 48000 // ratio)
            assert got[i].n_frames == frames and got[i].quality == pytest.approx(q, abs=2e-6) and got[i].passed == (q >= 0)
            checked += 1
    assert checked > 15
