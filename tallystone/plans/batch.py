"""One run over a folder of quotations: files, texts, answers, checks, comparison, and the tables of the report.

Everything up to the comparison is narrow work per file. Answers of the model are kept in a table by the hash
of the prompt, so that a rerun asks only for what is new, whatever the files are called.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare as C
from ..operators import extraction as X
from ..schemas import MATCH_PAYLOAD
from ..sources import files as S
from ..sources.settings import DEFAULTS, layered
from ..workspace import checkpointed, scratch
from . import reports as P
from . import rules as R

#: Short prompts of our own; a run can be given others with the same places.
QUOTE_PROMPT = "文件名: {{file_name}}\n从下面的报价单原文逐字提取供应商与报价行，只输出 JSON。\n\n{{raw_text}}"
MATCH_PROMPT = "判断每一对物料描述是否为同一物料；拿不准时 same=false 或 confidence=low。只输出 JSON。\n\n{{pairs_json}}"
PAIRS_PER_PROMPT = 200


@dataclass
class Run:
    """The tables of a run."""

    files: DataFrame
    raw: DataFrame
    quotes: DataFrame
    lines: DataFrame
    findings: DataFrame
    entries: DataFrame
    groups: DataFrame
    missing: DataFrame
    suppliers: DataFrame
    notes: DataFrame
    failures: DataFrame


def answered(prompts: DataFrame, make: Callable[[], X.Transport], system: str, name: str, schema: dict, cache: str | None = None, mode: str = "json_schema", retries: int = X.MAX_RETRIES, delay: float = X.RETRY_DELAY, recordings: DataFrame | None = None) -> DataFrame:
    """prompts with answer and error. With a cache path, good answers are kept there by the hash of the whole request and not asked again. With recordings nobody is asked: the answers are joined."""
    spark = prompts.sparkSession
    if recordings is not None:
        return checkpointed(X.with_json(X.replayed(prompts, recordings, system, name, schema, mode)))
    keyed = prompts.withColumn("request", F.sha2(F.concat_ws("\n", F.lit(system), F.lit(name), F.lit(mode), "prompt"), 256))
    call = lambda rows: X.call_model(rows, make, system, name, schema, mode, retries, delay)
    if cache is None:
        return checkpointed(call(keyed))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    known = spark.read.parquet(cache).select("request", "answer").dropDuplicates(["request"]) if there else None
    new = keyed.join(known, "request", "left_anti") if there else keyed
    asked = checkpointed(call(new))
    asked.filter("error is null").select("request", "answer").dropDuplicates(["request"]).write.mode("append").parquet(cache)
    if not there:
        return asked
    old = keyed.join(known, "request").withColumn("error", F.lit(None).cast("string"))
    return checkpointed(asked.unionByName(old))


def extracted(files: DataFrame, engine: S.OcrEngine, threshold: float, cache: str | None = None) -> DataFrame:
    """The raw texts of files. With a cache path texts are kept there by kind and content and not read again; those with warnings, which another run may read better, aren't kept."""
    spark = files.sparkSession
    if cache is None:
        return S.extract(files, engine, threshold)
    keyed = files.withColumn("text_key", F.sha2(F.concat(F.encode(F.concat_ws("|", "kind", S.suffix(F.col("source_file")), F.lit(str(threshold)), F.lit("")), "UTF-8"), "content"), 256))
    keys, fields = keyed.select("source_file", "text_key"), ("raw_text", "extraction_warnings", "low_ocr_lines")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    known = spark.read.parquet(cache).dropDuplicates(["text_key"]) if there else None
    new = checkpointed(S.extract(keyed.join(known.select("text_key"), "text_key", "left_anti") if there else keyed, engine, threshold))
    old = checkpointed(keyed.select("source_file", "kind", "text_key").join(known.select("text_key", *fields), "text_key").drop("text_key")) if there else None
    new.filter(F.size("extraction_warnings") == 0).join(keys, "source_file").select("text_key", *fields).dropDuplicates(["text_key"]).write.mode("append").parquet(cache)
    return new.unionByName(old) if there else new


def match_answers(pairs: DataFrame, make: Callable[[], X.Transport] | None, per_prompt: int = PAIRS_PER_PROMPT, prompt: str = MATCH_PROMPT, **options) -> tuple[DataFrame, bool]:
    """(results, failed): the answers to all pairs in their order, asked in prompts of bounded length; failed if any prompt did."""
    part = F.floor(F.col("pair_id").cast("long") / per_prompt)
    shown = F.sort_array(F.collect_list(F.struct(F.col("pair_id").cast("long").alias("n"), F.struct(F.col("pair_id").alias("id"), F.col("a_text").alias("a"), F.col("b_text").alias("b")).alias("p"))))
    prompts = pairs.groupBy(part.alias("part")).agg(F.to_json(F.struct(F.transform(shown, lambda x: x["p"]).alias("pairs"))).alias("pairs_json"))
    asked = answered(prompts.select("part", X.prompt(prompt, pairs_json=F.col("pairs_json")).alias("prompt")), make, X.MATCH_SYSTEM, "item_match", X.MATCH_SCHEMA, **options)
    rows = asked.filter("error is null").select("part", F.posexplode(F.from_json("answer", MATCH_PAYLOAD)["results"]).alias("i", "r"))
    order = F.row_number().over(Window.orderBy("part", "i"))
    return rows.select("r.id", F.coalesce("r.same", F.lit(False)).alias("same"), "r.confidence", "r.reason", order.cast("long").alias("ord")), not asked.filter("error is not null").isEmpty()


def compare_lines(lines: DataFrame, make: Callable[[], X.Transport] | None = None, normalize=T.normalize_nfkc, **options) -> dict[str, DataFrame]:
    """entries, groups, missing, suppliers and notes from checked lines; without a transport only exact keys are aligned."""
    keyed = checkpointed(C.keyed(lines, normalize))
    merged = C.merge_last(keyed)
    suppliers = checkpointed(C.supplier_order(merged))
    merged = checkpointed(merged.join(suppliers, "supplier_name"))
    groups = checkpointed(C.first_groups(merged))
    notes = [C.merge_notes(keyed).select(F.lit(0).alias("kind"), F.struct("is_supplement", "source_file", "line_no").cast("string").alias("o"), "note")]
    mapping = groups.select("item_key", F.col("item_key").alias("final_key"), (F.row_number().over(Window.orderBy("group_place", "item_key")) - 1).alias("group_ord"), F.lit(False).alias("review"), F.array().cast("array<string>").alias("notes"))
    pairs = C.numbered(C.candidate_pairs(merged, groups, normalize)) if make or options.get("recordings") is not None else None
    if pairs is not None and not pairs.isEmpty():
        results, failed = match_answers(pairs, make, **options)
        if failed:
            bad = C.match_degraded(pairs)
            said = F.array_repeat(F.lit("物料对齐 LLM 失败，本组未经智能匹配，请人工确认"), F.coalesce("n_notes", F.lit(0)).cast("int"))
            mapping = mapping.drop("review", "notes").join(bad, "item_key", "left").select("item_key", "final_key", "group_ord", F.coalesce("review", F.lit(False)).alias("review"), said.alias("notes"))
            notes.append(lines.sparkSession.createDataFrame([(1, "", "物料对齐 LLM 失败，未做智能合并")], "kind int, o string, note string"))
        else:
            mapping = checkpointed(C.match_fold(groups, pairs, results))
            notes.append(mapping.select(F.explode("global_notes").alias("n")).select(F.lit(1).alias("kind"), F.format_string("%09d", "n.ord").alias("o"), "n.note"))
            mapping = mapping.drop("global_notes", "n_notes")
    names = groups.select(F.col("item_key").alias("final_key"), "item_name", "spec")
    mapping = checkpointed(mapping)
    mapped = merged.join(mapping.select("item_key", "final_key"), "item_key").withColumn("moved", (F.col("item_key") != F.col("final_key")).cast("int"))
    mapped = mapped.join(names.select("final_key", F.col("item_name").alias("group_name")), "final_key").withColumnRenamed("final_key", "group_key")
    place = mapped.withColumn("entry_ord", F.struct("moved", "supplier_ord", "first_ord"))
    notes.append(C.dedupe_notes(place).select(F.lit(2).alias("kind"), F.concat_ws("|", "group_key", F.col("entry_ord").cast("string")).alias("o"), "note"))
    entries = C.dedupe_in_group(place).drop("moved", "first_ord", "entry_ord", "group_name")
    kept = mapping.filter("item_key = final_key").select("final_key", "group_ord", "review", "notes").join(names, "final_key").withColumnRenamed("final_key", "group_key")
    entries = checkpointed(entries.join(kept.select("group_key", "review"), "group_key"))
    stats = C.group_stats(entries, "group_key")
    told = notes[0]
    for more in notes[1:]:
        told = told.unionByName(more)
    missing = C.missing_quotes(entries, "group_key").join(kept.select("group_key", "group_ord", T.display_text(F.col("item_name"), F.col("spec")).alias("item")), "group_key").join(suppliers, "supplier_name")
    return {"entries": entries, "groups": kept.join(stats, "group_key"), "missing": missing.select("group_key", "item", "supplier_name", "group_ord", "supplier_ord"), "suppliers": suppliers, "notes": told}


def run(
    spark: SparkSession, folder: str, make: Callable[[], X.Transport] | None = None, engine: S.OcrEngine = S.no_engine, settings: dict | None = None, cache: str | None = None, quote_prompt: str = QUOTE_PROMPT, match_prompt: str = MATCH_PROMPT,
) -> Run:
    """All tables of a run over a folder. Files that fail in any step are listed and don't stop the others.

    Without `make` the answers come from the settings: recordings in llm.replay_dir, else the endpoint that llm
    names. With a cache path answers are kept in cache/answers by their requests, and texts in cache/texts by the
    contents of their files, so that a rerun reads and asks only for what is new, whatever the files are called.
    """
    settings = settings or {}
    llm, compare = settings.get("llm", {}), settings.get("compare", {})
    replay = llm.get("replay_dir") if make is None else None
    make = make if make or replay else X.http_of(layered(DEFAULTS, settings)["llm"])
    options = {"cache": f"{cache}/answers" if cache else None, "recordings": X.recordings(spark, replay) if replay else None, "retries": int(llm.get("max_retries", X.MAX_RETRIES)), "delay": float(llm.get("retry_delay", X.RETRY_DELAY)), "mode": llm.get("structured_mode", "json_schema")}
    path = scratch(spark, "run")
    S.classify(S.scan(spark, folder)).write.parquet(f"{path}/files")
    files = spark.read.parquet(f"{path}/files")
    threshold = float(settings.get("ocr", {}).get("min_char_confidence", S.LOW_SCORE))
    extracted(files.filter("kind != 'unsupported'"), engine, threshold, f"{cache}/texts" if cache else None).write.parquet(f"{path}/raw")
    raw = spark.read.parquet(f"{path}/raw")
    limit = int(int(llm.get("context_chars", X.CONTEXT_CHARS)) * X.CONTEXT_SHARE)
    chunks = X.chunk_texts(raw.filter(~T.is_blank(F.col("raw_text"))), limit)
    prompts = chunks.select("source_file", "chunk_no", X.prompt(quote_prompt, file_name=F.col("source_file"), raw_text=F.col("chunk")).alias("prompt"))
    answers = answered(prompts, make, X.QUOTE_SYSTEM, "supplier_quote", X.QUOTE_SCHEMA, **options)
    quotes, lines = X.parse_files(raw, answers.select("source_file", "chunk_no", "answer", "error"))
    lines = checkpointed(R.check_snippets(lines, raw))
    at = F.col("line_no").cast("string")
    warned = lines.select("source_file", "line_no", F.explode(F.array_compact(F.array(F.when(F.col("h1"), F.concat(F.lit("H1 幻觉嫌疑: 第"), at, F.lit("行 source_snippet 无法在原文中检索到"))), F.when(F.col("ocr_low"), F.concat(F.lit("OCR 低置信: 第"), at, F.lit("行落在低置信 OCR 行上")))))).alias("w"))
    more = warned.groupBy("source_file").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "w"))), lambda x: x["w"]).alias("more"))
    several = R.supplier_names(raw).select("source_file", F.array(F.concat(F.lit("V7 供应商一致性: 文中出现多个供应商名称 "), F.array_join("names", "、"))).alias("v7"))
    none = F.array().cast("array<string>")
    quotes = quotes.join(more, "source_file", "left").join(several, "source_file", "left")
    quotes = checkpointed(quotes.select("source_file", "kind", "supplier_name", F.concat("warnings", F.coalesce("more", none), F.coalesce("v7", none)).alias("warnings")))
    checked = checkpointed(R.flag_suppliers(R.apply_rules(lines.drop("h1", "ocr_low"), compare | ({"units": settings["units"]} if "units" in settings else {})), raw))
    findings = R.findings(checked).unionByName(R.supplier_findings(raw))
    tables = compare_lines(checked.drop("line_findings"), make, prompt=match_prompt, **options)
    return Run(files.drop("content"), raw, quotes, checked.drop("line_findings"), findings, tables["entries"], tables["groups"], tables["missing"], tables["suppliers"], tables["notes"], P.failures(files, quotes))
