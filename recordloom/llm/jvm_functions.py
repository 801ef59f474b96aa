"""Functions that run in Spark's JVM, from the sources in ``jvm/``.

Sources are compiled on the driver by Janino, the compiler that Spark brings for its own generated code, and the classes
are handed to the executors as a jar, as ``SparkContext.addJar`` does it. Rows never leave the JVM for these functions.
"""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from functools import lru_cache
from importlib.resources import files

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PACKAGE = "recordloom.jvm"
#: The loader of the compiled classes, by application.
_loaders: dict[str, object] = {}


def _loader(spark: SparkSession):
    app = spark.sparkContext.applicationId
    if app not in _loaders:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook((files(__package__) / "jvm" / "TokenFiles.java").read_text(encoding="utf-8"))
        classes = compiler.getBytecodes()
        folder = tempfile.mkdtemp(prefix="recordloom-jar-")  # the driver's own server hands it out
        path = os.path.join(folder, "recordloom-jvm.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name in classes:
                jar.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
        spark.sparkContext._jsc.sc().addJar(path)
        _loaders[app] = compiler.getClassLoader()
    return _loaders[app]


def _new(spark: SparkSession, name: str):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    made = _loader(spark).loadClass(f"{PACKAGE}.{name}").getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0))
    return made.newInstance(gateway.new_array(jvm.java.lang.Object, 0))


def _register(spark: SparkSession, name: str, function) -> str:
    binary = spark._jvm.org.apache.spark.sql.types.DataType.fromJson('"binary"')
    spark._jsparkSession.udf().register(name, function, binary)
    return name


@lru_cache(8)
def pair_table(spec: str) -> tuple[bytes, int]:
    """What ``BytePairs`` needs of a byte-level tokenizer file, and the bytes that an id takes. Raises ValueError for other files."""
    data = json.loads(spec)
    model, pre = data["model"], data["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not plain or data["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not a byte-level tokenizer with the usual pattern")
    if any(not t["content"].startswith("<|") for t in data["added_tokens"]):
        raise ValueError("special tokens must start with <|")
    vocab = model["vocab"]
    # the byte-level alphabet: printable bytes stand for themselves, others for the characters from 256 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in letter):
        letter[b] = chr(256 + n)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    table = [vocab[letter[b]] for b in range(256)] + [i for a, b in pairs for i in (vocab[a], vocab[b], vocab[a + b])]
    top = max([*vocab.values(), *(t["id"] for t in data["added_tokens"])])
    return np.array(table, "<i4").tobytes(), 2 if top < 1 << 16 else 4


def byte_pairs(spark: SparkSession, text: Column, spec: str) -> Column:
    """A 0 and the ids of a text (never null), or a 1 and its UTF-8, if only the library can tell."""
    table, width = pair_table(spec)
    function = _new(spark, "BytePairs")
    function.load(table, width)
    return F.call_function(_register(spark, f"recordloom_byte_pairs_{abs(hash(table)):x}", function), text.cast("binary"))


def encode_blocks(spark: SparkSession, ids: Column, width: int) -> Column:
    return F.call_function(_register(spark, "recordloom_encode_blocks", _new(spark, "EncodeBlocks")), ids, F.lit(width))


def decode_blocks(spark: SparkSession, coded: Column, width: Column) -> Column:
    return F.call_function(_register(spark, "recordloom_decode_blocks", _new(spark, "DecodeBlocks")), coded, width)
