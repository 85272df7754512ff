"""The set of tables and CoNLL files that a conversion of nested documents gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.text import sanitize_doc_id
from tessera.operators import convert as K
from tessera.operators.clusters import coref_markers
from tessera.scratch import materialize, release
from tessera.sinks.files import conll_document_lines, write_lines, write_sidecar, write_table
from tessera.sources.corpus import file_digests

SPLITS = ["train", "dev", "test"]


def _markers(mentions: DataFrame) -> DataFrame:
    spans = mentions.where("is_exported").select(
        F.struct("mode", "doc_id").alias("doc_id"), "sentence_id", F.col("token_start").alias("start"), F.col("token_end").alias("end"), F.col("conll_chain_id").alias("cid")
    )
    return coref_markers(spans).select(F.col("doc_id.mode").alias("mode"), F.col("doc_id.doc_id").alias("doc_id"), "sentence_id", "token_id", "coref")


def _configuration(spark: SparkSession, **values: object) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def _scorer_commands(folder: str) -> list[str]:
    """What to call an external scorer with: gold against itself in both modes, key against itself and against the empty response."""
    gold = [f"{folder}/conll/{mode}/test" for mode in K.MODES]
    pairs = [(gold[0], gold[0]), *((f"{folder}/scorer/key", f"{folder}/scorer/{name}") for name in ("identity", "empty")), (gold[1], gold[1])]
    return [f'perl "$SCORER" all "{key}" "{response}" none' for key, response in pairs]


def write_conversion(
    docs: DataFrame, folder: str, char_end_mode: str = "inclusive", drop_singletons: bool = True, policy: str = "fail", skip_space: bool = True, allow_zero_based: bool = True, inputs: dict[str, str] | None = None
) -> DataFrame:
    """Convert docs (schemas.DOCUMENT with doc_id and split) and write the results below folder; returns the summary by mode and split.

    metadata/: doc_map, chain_map, mention_map, token_map, type_slice_map; validation/: errors, warnings, summary;
    conll/<mode>/<split> and conll/<mode>/all; scorer/: key, identity and empty response of the test split with zeros, command;
    conversion_config; input_manifest (size and SHA-256 of the files of each named input, and where the results are). Each is a
    folder of parts; CoNLL parts are in order of doc_id. Under the policy fail nothing is written if there is an error.
    """
    spark = docs.sparkSession
    named = docs.withColumn("doc_id", sanitize_doc_id("doc_id"))
    sentences, raw = K.flatten_corpus(docs)
    placed = materialize(K.place_mentions(sentences, raw, allow_zero_based), "placed")
    found = materialize(K.mention_map(placed, char_end_mode, drop_singletons, skip_space), "mentions")
    chains = materialize(K.chain_map(found, drop_singletons), "chains")
    issues = materialize(K.issues(found, chains, sentences, named.select("doc_id", "text")), "issues")
    K.apply_policy(found, issues, policy)
    tokens = materialize(K.token_map(sentences, placed, skip_space).join(named.select("doc_id", "split"), "doc_id"), "tokens")
    mentions = found.join(chains.select("mode", "doc_id", "chain_pos", "conll_chain_id"), ["mode", "doc_id", "chain_pos"], "left")
    doc_map = named.select(
        "doc_id", "split", "domain", "category_primary", F.size("sentences").alias("n_sentences"), F.coalesce(F.size("coreference_chains"), F.lit(0)).alias("n_chains")
    ).join(raw.groupBy("doc_id").agg(F.count("mpos").alias("n_mentions")), "doc_id", "left").na.fill(0, ["n_mentions"])
    tables = {
        "doc_map": (doc_map, S.DOC_MAP),
        "chain_map": (chains, S.CHAIN_MAP),
        "mention_map": (mentions.withColumnRenamed("text", "mention_text"), S.MENTION_MAP),
        "token_map": (tokens, S.TOKEN_MAP),
        "type_slice_map": (K.type_slice_map(found, chains, named), S.TYPE_SLICE_MAP),
    }
    for name, (table, order) in tables.items():
        write_table(table, f"{folder}/metadata/{name}", [c for c in order if c in table.columns])
    for name, severity in (("errors", "ERROR"), ("warnings", "WARN")):
        write_table(issues.where(F.col("severity") == severity), f"{folder}/validation/{name}", [c for c in S.ISSUES if c in issues.columns])
    total = K.summary(found, chains)
    total.write.json(f"{folder}/validation/summary")
    marks = _markers(mentions)
    # a line of every token, with its mode and split, once; the files below are stretches of it in order
    lines = materialize(K.conll_lines(tokens, marks).join(named.select("doc_id", "split"), "doc_id"), "lines")
    order = ["doc_id", "sentence_id", "token_id"]

    def write(own: DataFrame, path: str) -> None:
        write_lines(conll_document_lines(own), f"{folder}/{path}", order)

    for mode in K.MODES:
        own = lines.where(F.col("mode") == mode)
        write(own, f"conll/{mode}/all")
        for part in SPLITS:
            write(own.where(F.col("split") == part), f"conll/{mode}/{part}")
    test = lines.where((F.col("mode") == K.MODES[0]) & (F.col("split") == "test"))
    bare = test.withColumn("line", F.regexp_replace("line", r"\S+$", "-"))
    for name, own in (("key", test), ("identity", test), ("empty", bare)):
        write(own, f"scorer/{name}")
    spark.createDataFrame([(x,) for x in _scorer_commands(folder)], "value string").coalesce(1).write.text(f"{folder}/scorer/command")
    write_sidecar(
        _configuration(
            spark, char_end_mode=char_end_mode, skip_whitespace_tokens=skip_space, allow_zero_based_sentence_id=allow_zero_based, drop_singleton_chains=drop_singletons, error_policy=policy,
            tokenization="character", modes=",".join(K.MODES), splits=",".join(SPLITS),
        ),
        f"{folder}/conversion_config",
    )
    _write_manifest(spark, folder, inputs or {}, [*(f"metadata/{name}" for name in tables), *(f"conll/{mode}/{part}" for mode in K.MODES for part in SPLITS), "scorer/key", "scorer/identity", "scorer/empty", "scorer/command"])
    total = materialize(total, "summary")
    for done in (placed, found, chains, issues, tokens, lines):
        release(done)
    return total


def _write_manifest(spark: SparkSession, folder: str, inputs: dict[str, str], outputs: list[str]) -> None:
    """One object: the files of each named input with size and SHA-256, hashed in the workers, and the results' places."""
    none = spark.createDataFrame([], "input string, path string, size_bytes long, sha256 string")
    files = reduce(lambda a, b: a.unionByName(b), (file_digests(spark, path).withColumn("input", F.lit(name)) for name, path in inputs.items()), none)
    listed = files.agg(F.array_sort(F.collect_list(F.struct("input", "path", "size_bytes", "sha256"))).alias("inputs"))
    write_sidecar(listed.withColumn("outputs", F.array(*(F.lit(f"{folder}/{x}") for x in outputs))), f"{folder}/input_manifest")
