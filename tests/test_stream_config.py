"""Patterns published while a masking stream runs."""

import glob
import os

import pytest
from tests_helpers import lexicon

from velum.functions.patterns import PATTERN_SCHEMA
from velum.operators import kb
from velum.streaming import mask as stream_mask
from velum.streaming.config import SnapshotConfig, snapshot_labels


def publish(spark, root, *patterns):
    rows = spark.createDataFrame([(n, r, label, 0.8, True, "admin") for n, r, label in patterns], PATTERN_SCHEMA)
    return kb.publish(kb.snapshot_rows(lexicon(spark), rows), root)


def test_a_pattern_published_in_mid_stream(spark, tmp_path):
    root, out = str(tmp_path / "kb"), str(tmp_path / "out")
    config = SnapshotConfig(spark, root)

    def run(k):
        docs = spark.createDataFrame([(1, "s", "badge X-1234 of a@b.ch")], "doc_id int, scope string, text string")
        stream_mask.mask_batch(docs, k, out, "scope", config=config)
        return spark.read.parquet(f"{out}/masked/batch_id={k}").first().text

    assert run(0) == "badge X-1234 of [EMAIL_1]" and config.version is None
    first = publish(spark, root, ("badge", r"\bX-[0-9]{4}\b", "BADGE"), ("bad", "(a+)+", "NOPE"))
    with pytest.warns(UserWarning, match="patterns refused: bad"):
        assert run(1) == "badge [BADGE_1] of [EMAIL_1]"
    assert config.version == first and snapshot_labels(config.reader.rows).count() == lexicon(spark).where("status = 'active'").count()
    # a snapshot that cannot be read: the last good one stays, with the reason
    second = publish(spark, root, ("other", r"\bof\b", "WORD"))
    for file in glob.glob(os.path.join(root, second, "**", "*.json"), recursive=True):
        os.remove(file)
    os.rename(os.path.join(root, second, "items"), os.path.join(root, second, "gone"))
    with pytest.warns(UserWarning, match="is kept"):
        assert run(2) == "badge [BADGE_1] of [EMAIL_1]"
    assert config.version == first and config.problem
    third = publish(spark, root, ("third", r"\bbadge\b", "WORD"))
    assert run(3) == "[WORD_1] X-1234 of [EMAIL_1]" and config.version == third and config.problem is None
