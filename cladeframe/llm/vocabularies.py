"""Files of public tokenizers: read once by the driver, sent to the tasks as broadcast bytes.

A vocabulary's size is fixed by its tokenizer, some megabytes, whatever the corpus.
"""

from __future__ import annotations

from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession


def vocabulary_path(name: str) -> str:
    """Where the file ``name`` of the installed collection of public tokenizers is."""
    try:
        import public_tokenizers
    except ModuleNotFoundError as e:
        raise FileNotFoundError(f"no collection of public tokenizers is installed; give a path to {name}") from e
    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> bytes:
    file = Path(path)
    if not file.is_file():
        raise FileNotFoundError(f"vocabulary file {path} is absent; give its path as a parameter")
    return file.read_bytes()


def broadcast_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_vocabulary(path))
