"""Which chunks a stage looks at: its keywords, what other tables know of their files, and what is in focus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import priority_boost
from ..functions.keywords import keyword_counts
from ..functions.text import fixed, text_or_empty
from .rule_hits import top

#: Words by which chunks speak for the stages that have no score of their own.
STAGE_KEYWORDS: dict[int, tuple[str, ...]] = {
    2: (
        "exec", "subprocess", "system", "shell", "eval", "popen", "runtime.exec", "processbuilder", "child_process", "pickle", "unserialize", "yaml.load", "marshal", "deserialize", "proc_open", "pcntl_exec", "assert",
        "vm.run", "class.forname", "scriptengine", "objectinputstream", "os/exec", "exec.command", "spawn", "compile", "jinja2", "freemarker", "velocity", "ognl", "spel", "mvel",
    ),
    3: (
        "sql", "query", "cursor", "mongodb", "redis", "orm", "database", "select ", "insert ", "update ", "delete ", "execute(", "raw(", "executescript(", "rawsql", "raw_query", "preparedstatement", "jdbctemplate", "hibernate",
        "mybatis", "sequelize", "knex", "typeorm", "prisma", "mongoose", "db.query", "db.exec", "gorm", "sqlx", "$where", "ldap_search", "graphql",
    ),
    7: (
        ".env", "config", "settings", "docker", "compose", "yaml", "yml", "toml", "ini", "requirements", "package.json", "secret", "api_key", "private_key", "access_key", "credentials", "db_password", "database_url", "debug=true",
        "cors_origin", "allowed_hosts", "ssl", "tls", "aws_secret", "azure_key", "gcp_key", "kubernetes", "nginx", "apache", "github_token", "slack_token", "stripe_key", "0.0.0.0", "verify=false",
    ),
    9: (
        "order", "payment", "amount", "price", "inventory", "coupon", "workflow", "status", "balance", "logic", "business", "refund", "withdraw", "deposit", "transfer", "invoice", "billing", "receipt", "tax", "discount", "promo",
        "voucher", "reward", "stock", "quantity", "merchant", "customer", "settlement", "commission", "profit", "approve", "reject", "cancel", "confirm", "points", "level", "vip", "membership", "quota", "threshold",
    ),
}
#: Characters that are looked through; points of keywords, files with hints, files and functions in focus; how many chunks a stage has at most and at least.
HEAD, KEYWORD, HINTED, FOCUS_FILE, FOCUS_FUNCTION, MOST, LEAST = 4000, 12, 10, 30, 8, 32, 16


def select_stage_chunks(
    chunks: DataFrame, routes: DataFrame, evidence: DataFrame, hints: DataFrame, focus_files: DataFrame | None = None, focus_functions: DataFrame | None = None, keywords: dict[int, Sequence[str]] | None = None
) -> DataFrame:
    """Per project and stage the chunks to look at: project, stage_num, chunk_ordinal, score, rank, is_filler.

    Files are told apart in lower case. ``routes`` (project, file_path) and ``evidence``
    (project, path) speak for a file in all stages, ``hints`` (project, file_path,
    stage_nums) and the files and functions in focus (project, path; project, name) for
    chunks. Chunks with a keyword or any point are ranked, equal ones by path and order, up
    to 32; where these are fewer than 16, the first of the others fill up. A chunk's text is
    looked through once for the words of all stages.
    """
    words = keywords or STAGE_KEYWORDS
    stages = list(words)
    low = lambda c: F.lower(F.trim(text_or_empty(c)))
    known = lambda df, c: df.select("project", low(c).alias("_f")).filter("_f <> ''").distinct()
    hinted = hints.select("project", low("file_path").alias("_f"), F.explode("stage_nums").alias("_s")).filter("_f <> ''").groupBy("project", "_f").agg(F.collect_set("_s").alias("_hinted"))
    c = chunks.withColumn("base_file_path", F.coalesce(F.nullif("base_file_path", F.lit("")), F.col("file_path"))).withColumns({"_path": low("file_path"), "_base": low("base_file_path")})

    def flagged(df: DataFrame, known_files: DataFrame, on: str, name: str) -> DataFrame:
        return df.join(known_files.withColumnRenamed("_f", on).withColumn(name, F.lit(True)), ["project", on], "left")

    c = flagged(flagged(c, known(routes, "file_path"), "_base", "_routed"), known(evidence, "path"), "_base", "_evident")
    c = c.join(hinted.withColumnsRenamed({"_f": "_base", "_hinted": "_base_hinted"}), ["project", "_base"], "left").join(hinted.withColumnRenamed("_f", "_path"), ["project", "_path"], "left")
    c = flagged(c, known(focus_files, "path"), "_path", "_focused") if focus_files is not None else c.withColumn("_focused", F.lit(False))
    if focus_functions is not None:
        named = focus_functions.select("project", low("name").alias("_n")).filter("_n <> ''").groupBy("project").agg(F.collect_set("_n").alias("_functions"))
        c = c.join(F.broadcast(named), "project", "left")  # a short list a project, made by hand
    else:
        c = c.withColumn("_functions", F.lit(None).cast("array<string>"))
    c = fixed(c, _head=F.lower(F.substring(text_or_empty("content"), 1, HEAD)))
    c = fixed(c, _n=keyword_counts(F.concat_ws("\n", F.lower(text_or_empty("file_path")), "_head"), list(words.values())), _called=F.coalesce(F.exists("_functions", lambda f: F.contains(F.col("_head"), f)), F.lit(False)))
    true = lambda name: F.coalesce(F.col(name), F.lit(False))

    def of_stage(i: int, stage: int) -> Column:
        here = lambda name: F.coalesce(F.array_contains(name, stage), F.lit(False))
        points = priority_boost(stage, true("_routed"), true("_evident") | here("_base_hinted"))
        points = points + F.when(here("_hinted"), HINTED).otherwise(0) + F.when(true("_focused"), FOCUS_FILE).otherwise(0) + F.when(F.col("_called"), FOCUS_FUNCTION).otherwise(0)
        worded = F.col("_n")[i] > 0
        return F.struct(F.lit(stage).alias("stage_num"), (points + F.when(worded, KEYWORD).otherwise(0)).alias("score"), (worded | (points > 0)).alias("counts"))

    each = c.select("project", "chunk_ordinal", F.col("file_path").alias("_name"), F.explode(F.array(*[of_stage(i, s) for i, s in enumerate(stages)])).alias("_s")).select("project", "chunk_ordinal", text_or_empty("_name").alias("_name"), "_s.*")
    by = ["project", "stage_num"]
    good = top(each.filter("counts"), by, [F.desc("score"), F.col("_name"), F.col("chunk_ordinal")], MOST).withColumn("is_filler", F.lit(False))
    others = top(each.filter("NOT counts"), by, [F.col("chunk_ordinal")], LEAST).withColumn("is_filler", F.lit(True))
    found = good.groupBy(*by).agg(F.count(F.lit(1)).alias("_good"))
    filled = others.join(found, by, "left").withColumn("rank", F.col("rank") + F.coalesce("_good", F.lit(0))).filter(F.col("rank") <= LEAST).drop("_good")
    return good.unionByName(filled).select(*by, "chunk_ordinal", "score", "rank", "is_filler")
