import pickle
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftlens.llm import arrowtext as at
from weftlens.llm import attention_lm
from weftlens.llm.queries import vocabulary


def test_a_process_keeps_one_table_of_words():
    spelling = attention_lm.Spelling("", "", np.zeros(1, np.int64), np.ones(1, bool))
    model = attention_lm.Model(spelling, None, 0.5, np.zeros(0, at.U64), np.zeros(0, np.int64), 0, 0, 0)
    table = model.words()
    assert model.words() is table
    sent = pickle.loads(pickle.dumps(model))
    assert "_words" not in sent.__dict__ and sent.total == 0 and sent.words() is sent.words()


def test_units_are_chosen_by_all_training_documents(spark, monkeypatch):
    class Done(Exception):
        pass

    seen = []

    def choose(words, *_):
        seen.append(words)
        raise Done

    monkeypatch.setattr(attention_lm, "choose_units", choose)
    made = [(k, f"word{k}") for k in range(3400)] + [(None, "long " * 30_000)]
    rows = spark.createDataFrame(made, "doc_id long, text string")
    with pytest.raises(Done):
        attention_lm.fit(rows, attention_lm.count_words(rows), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    assert seen == [{t.encode(): 1 for k, t in made[:-1] if zlib.crc32(str(k).encode()) % 5 != 1} | {b"long": 30_000}]


def test_chunks_hold_every_unit():
    sizes = np.array([3, 2500, 1, 1000, 1, 4000])
    units = np.arange(sizes.sum()).astype("<u2")
    blobs = attention_lm._blobs(units, sizes)
    batches = [pa.RecordBatch.from_arrays([part], names=["units"]) for part in (blobs[:2], blobs[2:5], blobs[5:])]
    got = list(attention_lm._chunks(batches, 1000))
    assert np.concatenate([u for u, _ in got]).tolist() == units.tolist()
    assert all(s.sum() == len(u) and s.max() <= 1000 for u, s in got)


def test_a_round_gives_the_mean_of_its_tasks(spark):
    spelling = attention_lm.Spelling("", "", np.zeros(1, np.int64), np.ones(40, bool))
    net, alone = (attention_lm.Attention(spelling, np.arange(40)) for _ in range(2))
    start = net.weights()
    made = [(k, bytearray(np.random.default_rng(k).integers(0, 40, 50 + k).astype("<u2").tobytes())) for k in range(30)]
    rows = spark.createDataFrame(made, "o long, units binary")
    total = sum(50 + k for k in range(30))
    attention_lm._one_round(rows, net, spelling.begin, total, (0.0, 1.0), 40, 1000, 20)
    dealt = rows.repartition(20, "o").sortWithinPartitions("o").rdd.mapPartitionsWithIndex(lambda k, part: [(k, [bytes(r.units) for r in part])]).collect()
    ends = np.zeros(len(start))
    for k, parts in dealt:
        alone.put(start)
        units = [np.frombuffer(x, "<u2").astype(np.int64) for x in parts]
        got = [(np.concatenate(units), np.array([len(x) for x in units]))] if units else []
        ends += alone.train(got, spelling.begin, total * 40 // 20, passes=40, seed=4 + k) / (40 * total) * alone.weights()
    off, moved = np.abs(net.weights() - ends), np.abs(net.weights() - start)
    assert off.max() < 1e-3 < moved.max()
