"""File corpora: recursive scans, languages by suffix and by content, frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 1 << 20
# Folders that hold no own code, and suffixes with their languages (first match).
SKIPPED = ("node_modules", ".git", "lib", "out", "artifacts", "cache", "build", "dist", "target", "vendor", "__pycache__")
SUFFIXES = (
    (".sol", "solidity"), (".vy", "vyper"), (".move", "move"), (".cairo", "cairo"), (".clar", "clarity"), (".fc", "func"), (".func", "func"), (".huff", "huff"), (".yul", "yul"),
    (".scilla", "scilla"), (".tz", "michelson"), (".wat", "webassembly"), (".wast", "webassembly"), (".sass", "sass"), (".go", "go"), (".ts", "ts-sdk"), (".tsx", "ts-sdk"), (".rs", "rust"),
)
TEST_SUFFIXES = (".t.sol", ".s.sol", ".test.ts", ".spec.ts", "_test.go")


def read_corpus(spark: SparkSession, root: str, suffixes: tuple[str, ...] = tuple(s for s, _ in SUFFIXES), max_bytes: int = MAX_BYTES, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path, bytes, text of the files below ``root``.

    Suffixes are a file filter and the size comes from the file's metadata, so
    that other files are not read.
    """
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    folder = "/(" + "|".join(x.replace(".", "[.]") for x in skipped) + ")/"
    return files.where((F.col("_metadata.file_size") <= max_bytes) & ~F.col("_metadata.file_path").rlike(folder)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("text"))


def language_of(path: Column) -> Column:
    low = F.lower(path)
    return F.coalesce(*[F.when(low.endswith(s), lang) for s, lang in SUFFIXES], F.lit("unknown"))


def is_test(path: Column) -> Column:
    out = F.lit(False)
    for s in TEST_SUFFIXES:
        out = out | F.lower(path).endswith(s)
    return out


def rust_kind(text: Column) -> Column:
    """Kinds of contract that share the suffix .rs, by their first 8000 characters."""
    head = F.left(F.coalesce(text, F.lit("")), F.lit(8000))
    return F.when(head.rlike("cosmwasm_std|#\\[entry_point\\]"), "cosmwasm").when(head.rlike("#\\[ink::contract|ink_lang|#\\[ink\\("), "ink").when(head.rlike("frame_support|#\\[pallet::|decl_module!"), "substrate").otherwise("solana")


def tag_language(files: DataFrame) -> DataFrame:
    lang = language_of(F.col("path"))
    return files.withColumn("lang", F.when(lang == "rust", rust_kind(F.col("text"))).otherwise(lang)).where(~is_test(F.col("path")))


def detect_framework(files: DataFrame) -> DataFrame:
    """repo, framework, pragmas of file lists (repo, path, text)."""
    name = F.element_at(F.split("path", "/"), -1)
    has = lambda *names: F.bool_or(name.isin(*names))
    flags = files.groupBy("repo").agg(
        has("foundry.toml").alias("foundry"), has("hardhat.config.js", "hardhat.config.ts").alias("hardhat"), has("truffle-config.js").alias("truffle"), has("brownie-config.yaml").alias("brownie"),
        F.array_sort(F.collect_set(F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), "pragma solidity ([^;]+);", 1), F.lit("")))).alias("pragmas"),
    )
    kind = F.when(F.col("foundry"), "foundry").when(F.col("hardhat"), "hardhat").when(F.col("truffle"), "truffle").when(F.col("brownie"), "brownie").otherwise("unknown")
    return flags.select("repo", kind.alias("framework"), F.slice("pragmas", 1, 10).alias("pragmas"))
