"""What makes the corpus operators grow beyond need, in the driver or in tasks."""

import numpy as np

from quire.llm import media, simhash, webp, webp_write


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_crowded_prints_and_rounds_are_joined_without_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(2)
    flips = np.uint64(1) << rng.integers(0, 64, (60, 2), dtype=np.uint64)
    prints = np.unique(np.uint64(123456789) ^ flips[:, 0] ^ flips[:, 1]).view(np.int64)
    hot = spark.createDataFrame([(int(p),) for p in prints], "print long").repartition(2)
    links = simhash.spread(hot)
    assert "BroadcastHashJoin" not in executed(links)
    plans, kept = [], simhash.checkpoint
    monkeypatch.setattr(simhash, "checkpoint", lambda df: plans.append(executed(df)) or kept(df))
    roots = simhash.components(links).toPandas()
    assert set(roots.node) == set(prints.tolist()) and set(roots.root) == {prints.min()}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_pictures_keep_step_and_read_as_at_every_bit(monkeypatch):
    rng = np.random.default_rng(7)
    words = rng.integers(0, 2**32, 400, dtype=np.uint32)
    made = [words[rng.integers(0, 400, w * h)] for w, h in zip(rng.integers(9, 30, 40), rng.integers(9, 40, 40), strict=True)] + [np.full(300, 7, np.uint32)]
    widths = [int(next(w for w in range(9, 301) if len(p) % w == 0)) for p in made]
    for plan in ([], ["less_green", "predict"], ["predict", "cross"]):
        batch = webp_write.Batch(made, widths)
        for step in plan:
            getattr(batch, step)(np.arange(len(made)))
        streams, slow = batch.streams(), []
        monkeypatch.setattr(webp, "STEP", 2)
        with monkeypatch.context() as m:
            m.setattr(webp, "at_every_bit", lambda bits, which, *a, f=webp.at_every_bit: slow.extend(which) or f(bits, which, *a))
            stepped = webp.decode(streams)
        assert len(slow) < 5
        monkeypatch.setattr(webp, "STEP", 10**6)
        for p, a, b in zip(made, stepped, webp.decode(streams), strict=True):
            assert (a.pixels == p).all() and (b.pixels == p).all()


def test_texts_are_written_without_what_only_pictures_gain_from():
    rng = np.random.default_rng(3)
    lexicon = [bytes(rng.integers(97, 123, n).tolist()).decode() for n in rng.integers(2, 9, 300)]
    payloads = [media.padded(" ".join(lexicon[i] for i in rng.integers(0, 300, 900)))[0] for _ in range(120)]
    forms = [media.form_of(np.frombuffer(p, "<u4"), p) for p in payloads]
    assert set(forms) == {1, 2, 3} and media.PLANS[1] == [] and forms.count(1) > 80
    stored = media.write(payloads)
    assert media.read(stored)[1] == payloads
    size = lambda k: np.mean([len(s) / len(p) for s, p, f in zip(stored, payloads, forms, strict=True) if f == k])
    assert size(1) < size(2) and size(1) < size(3)
