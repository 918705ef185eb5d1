"""A key that many different texts share."""

from ledgerlake.llm import sharding


def test_texts_of_one_key_are_spread(spark):
    rows = [(1, f"text {i}") for i in range(600)] + [(None, f"text {i}") for i in range(300)] + [(1, "text 5")] * 9
    got = sharding.shard_layout(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for key in (1, None):
        mine = sorted((r.slot, r.size, r.text_crc32) for r in got if r.doc_id == key)
        assert [m[1:] for m in mine] != sorted(m[1:] for m in mine)  # not one bucket, which is in this order
        assert len({r.shard for r in got if r.doc_id == key}) == 1
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
