import zlib

import numpy as np
import pytest

from medialib.llm import training_order as order
from medialib.session import scratch_dir


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_and_its_inverse(count):
    x = np.arange(count)
    slots = order.permute(x, count, key=99)
    assert sorted(slots) == list(range(count))
    assert (order.permute(slots, count, key=99, inverse=True) == x).all()
    if count > 50:
        assert (slots != order.permute(x, count, key=100)).any() and (slots != x).any()


def test_shards_round_trip_and_resume(spark, frame, prose, tmp_path):
    from tokenizers import Tokenizer

    from medialib.llm.tokens import default_path
    tok = Tokenizer.from_file(default_path())
    rows = [(i, prose(1 + i * 13 % 400, i)) for i in range(120)] + [(500, None), (501, ""), (None, "a"), (0, prose(1, 0))]
    path = f"{scratch_dir(spark)}/{tmp_path.name}-shards"
    count = order.materialise(frame(rows), path, key=5, length=128, per_shard=128)
    back = order.read_from(spark, path, length=128).collect()
    want = []
    for d, t in rows:
        own = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(-1 if d is None else d, k, own[s:s + 128]) for k, s in enumerate(range(0, len(own), 128))]
    assert sorted((r.doc_id, r.piece, r.ids) for r in back) == sorted(want)
    assert sorted(r.slot for r in back) == list(range(count)) and count == len(want)
    assert all(r.shard == r.slot // 128 and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) for r in back)
    for start in (0, 1, 63, 64, 130, count - 1):
        assert sorted(r.slot for r in order.read_from(spark, path, start, 128).collect()) == list(range(start, count))
    # Blobs have a fixed stride: the record of a slot lies where its number says.
    blob = spark.read.parquet(path).where("first_slot = 64").first()
    size = order.stride(128)
    one = next(r for r in back if r.slot == 70)
    assert np.frombuffer(blob.payload[6 * size:7 * size], order.HEAD, 1)[0]["doc_id"] == one.doc_id
    assert spark.read.parquet(path).groupBy("shard").count().where("count > 2").isEmpty()


def test_empty_table(spark, frame, tmp_path):
    path = f"{scratch_dir(spark)}/{tmp_path.name}-none"
    assert order.materialise(frame([]), path, key=1) == 0
    assert order.read_from(spark, path).collect() == []
