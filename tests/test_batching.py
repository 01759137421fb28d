import numpy as np
import pytest
from pyspark.sql import functions as F

from captionloom.plans.batching import token_batches
from captionloom.settings import DataSettings
from captionloom.sources import shards, vocab


def test_settings_are_strict():
    with pytest.raises(ValueError, match="colour"):
        DataSettings.from_dict({"shards_path": "s", "tokenizer_path": "t", "colour": 1})
    assert DataSettings.from_dict({"shards_path": "s", "tokenizer_path": "t", "num_workers": 4, "shuffle_buffer": 9}).batch_size == 8
    with pytest.raises(TypeError):
        DataSettings.from_dict({"tokenizer_path": "t"})
    assert DataSettings.from_dict({"shards_path": "s", "tokenizer_path": "t"}).caption_dropout == 0.1


def test_shards_to_batches(spark, tmp_path):
    text = F.when(F.col("id") == 3, F.lit("<br>")).otherwise("Ab")
    rows = spark.range(10).select(
        F.lit("000000").alias("shard"), F.format_string("sample-%09d", "id").alias("key"),
        F.create_map(F.lit("jpg"), F.encode(F.lit("x"), "UTF-8"), F.lit("txt"), F.encode(text, "UTF-8")).alias("members"),
    )
    shards.write_shards(rows, str(tmp_path / "shards"))
    pieces = ["<pad>", "<s>", "</s>", "<unk>", "<null>", "ab", "▁ab", "a", "b", "▁"]
    table = spark.createDataFrame([(i, p, float(min(0, 5 - i))) for i, p in enumerate(pieces)], "id int, piece string, score double")
    vocab.write_vocab(table, str(tmp_path / "vocab"))
    settings = DataSettings(str(tmp_path / "shards"), str(tmp_path / "vocab" / "tokenizer.vocab"), batch_size=4, caption_dropout=0.5, max_length=3)
    made = token_batches(spark, settings, seed=1).orderBy("batch_id").collect()
    assert [r.batch_rows for r in made] == [4, 4, 1]
    keys = [k for r in made for k in r.key]
    assert sorted(keys) == [f"sample-{i:09d}" for i in range(10) if i != 3] and keys != sorted(keys)
    assert {tuple(t) for r in made for t in r.tokens} == {(6, 0, 0), (4, 0, 0)}
    assert {tuple(m) for r in made for m in r["mask"]} == {(1, 0, 0)}
    drawn = token_batches(spark, settings, seed=1, draws=3, media=lambda raw: np.frombuffer(raw, np.uint8)).collect()
    keys = [k for r in drawn for k in r.key]
    assert len(keys) == 27 and sorted({k.split("/")[0] for k in keys}) == [f"{i:09d}" for i in range(3)]
    assert all(s == [1] and v == [120.0] for r in drawn for s, v in zip(r.shape, r["values"]))
    again = token_batches(spark, settings, seed=1).orderBy("batch_id").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in made]
