"""Checks that stop a run before it does harm. Each raises ValueError or returns."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Least free bytes, and most downloaded ones; what a finished run leaves; the sealed test tokens.
FREE_BYTES, TOTAL_BYTES = 25 << 30, 8 << 30
RUN_FILES = ("latest.pt", "best.pt")
SEALED = "test.bin"


def retention_factors(eligible: float, hard_stop: float) -> None:
    """Both are positive, and a run is refused before it is stopped."""
    if min(eligible, hard_stop) <= 0:
        raise ValueError(f"retention factors must be positive: {eligible}, {hard_stop}")
    if eligible >= hard_stop:
        raise ValueError(f"the eligibility factor {eligible} isn't below the hard stop {hard_stop}")


def replay_source(path: str) -> None:
    """The sealed test tokens are never replayed."""
    if SEALED in path:
        raise ValueError(f"{path} is sealed")


def free_folder(spark: SparkSession, folder: str, files: tuple[str, ...] = RUN_FILES) -> None:
    """A folder, on any store, that holds none of a run's files."""
    for name in files:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            raise ValueError(f"{target} exists; it is not overwritten")


def within_limits(free: int, downloaded: int, least_free: int = FREE_BYTES, most: int = TOTAL_BYTES) -> None:
    if free < least_free:
        raise ValueError(f"{free} bytes free, under {least_free}")
    if downloaded > most:
        raise ValueError(f"{downloaded} bytes downloaded, over {most}")


def matching_config(config: dict[str, int], dataset: dict, tokenizer: dict) -> None:
    """vocab_size and the ids of pad, bos, eos and unk agree with what the metadata of corpus and tokenizer say; what they don't say isn't checked."""
    said = {"dataset": {"vocab_size": dataset.get("tokenizer_vocab_size")}, "tokenizer": {"vocab_size": tokenizer.get("vocab_size")}}
    for name in ("pad", "bos", "eos", "unk"):
        said["dataset"][f"{name}_id"] = dataset.get("special_token_ids", {}).get(name)
        said["tokenizer"][f"{name}_id"] = tokenizer.get(f"{name}_id")
    wrong = [f"{key} is {config.get(key)}, {where} says {value}" for where, values in said.items() for key, value in values.items() if value is not None and config.get(key) != value]
    if wrong:
        raise ValueError("; ".join(wrong))
