"""States of runs and tasks from their events: transitions that no later one undoes, claims, and events told in a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import text_or_empty
from .events import TERMINAL

#: How long a message is at most.
MESSAGE_CHARS = 2000


def run_states(transitions: DataFrame) -> DataFrame:
    """Per run its state after all transitions (task_id, run_id, seq, status, message, at): the first terminal one, which nothing undoes, else the last; started_at, completed_at and the message of a failure."""
    ends = F.col("status").isin(*TERMINAL)
    row = F.struct("seq", "status", F.substring(text_or_empty("message"), 1, MESSAGE_CHARS).alias("message"), "at")
    state = transitions.groupBy("task_id", "run_id").agg(F.min(F.when(ends, row)).alias("_end"), F.max(row).alias("_last"), F.min("at").alias("started_at"))
    failed = F.col("_end.status") == "failed"
    return state.select("task_id", "run_id", F.coalesce("_end.status", "_last.status").alias("status"), "started_at", F.col("_end.at").alias("completed_at"), F.when(failed, F.col("_end.message")).otherwise("").alias("error_message"))


STATE = "status string, started_at timestamp, completed_at timestamp, error_message string"


def claims(tasks: DataFrame, runs: DataFrame, workers: int = 1) -> DataFrame:
    """The next tasks to run, as many as there are workers: pending ones in the queue that nobody has claimed, by creation. Adds place and mode: full at first, rerun if the task has run before."""
    waiting = tasks.filter((F.col("status") == "pending") & F.col("queued") & F.col("claimed_at").isNull())
    first = waiting.orderBy("created_at", "task_id").limit(workers)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy("created_at", "task_id")))
    before = runs.select("task_id").distinct().withColumn("_ran", F.lit(True))
    return ranked.join(before, "task_id", "left").withColumn("mode", F.when(F.coalesce("_ran", F.lit(False)), "rerun").otherwise("full")).drop("_ran")


def recovered(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Queued or running tasks after a restart, with the stages to go on with: those selected that are running, which begin anew, or pending. Without any, the task leaves the queue (queued is false). any_stage tells whether the task has stages at all."""
    live = tasks.filter(F.col("queued") | (F.col("status") == "running"))
    wanted = ((F.size("selected_stage_nums") <= 0) | F.array_contains("selected_stage_nums", F.col("stage_num"))) & F.col("status").isin("pending", "running")
    left = stages.join(live.select("task_id", "selected_stage_nums"), "task_id").groupBy("task_id").agg(F.array_sort(F.collect_set(F.when(wanted, F.col("stage_num")))).alias("remaining"))
    out = live.select("task_id").join(left, "task_id", "left").withColumn("any_stage", F.col("remaining").isNotNull()).withColumn("remaining", F.coalesce("remaining", F.array().cast("array<int>")))
    return out.withColumn("queued", F.size("remaining") > 0)


#: Events that are told by one sentence; those with a mode, at first and otherwise; modes.
PLAIN = {
    "run.completed": "审计流程已完成", "run.failed": "任务执行失败", "run.cancelled": "任务已取消", "run.paused": "任务已暂停，可在阶段边界恢复", "review.started": "Supervisor 开始复核审计结果",
    "worker.recovered": "启动时恢复未完成任务",
}
MODED = {"run.queued": ("已入队等待执行", "已入队", "重跑"), "run.started": ("开始执行", "开始执行", "重跑"), "run.resumed": ("已恢复执行", "已恢复执行", "续跑")}


def sentence() -> Column:
    """An event (event_type, stage_num, payload as JSON) in a sentence; its message for kinds that have none of their own."""
    get = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("payload", f"$.{n}"), F.lit("")) for n in names])
    or_ = lambda c, text: F.coalesce(c, F.lit(text))
    kind = F.col("event_type")
    stage = F.when(F.col("stage_num").isNotNull(), F.concat(F.lit("阶段 "), F.col("stage_num").cast("string")))
    stages = lambda name: F.coalesce(F.array_join(F.from_json(F.get_json_object("payload", f"$.{name}"), "array<string>"), "、"), F.lit(""))
    role = or_(get("role", "agent_role"), "Agent")
    why = {"run.completed": get("message"), "run.failed": get("error_message", "message"), "run.cancelled": get("reason", "message"), "run.paused": get("reason")}
    mode = get("mode")
    out = None
    for name, text in PLAIN.items():
        told = or_(why.get(name, F.lit(None).cast("string")), text)
        out = F.when(kind == name, told) if out is None else out.when(kind == name, told)
    for name, (full, other, again) in MODED.items():
        named = F.concat(F.lit(other + "（"), F.when(mode == "rerun", again).otherwise(mode), F.lit("）"))
        out = out.when(kind == name, F.when(mode.isNotNull() & (mode != "full"), named).otherwise(full))
    name = F.coalesce(get("name"), F.concat(F.lit("Phase "), get("phase")))
    unknown = or_(get("error_message", "message"), "未知原因")
    attempt = F.coalesce(F.concat(F.lit("（第 "), get("attempt"), F.lit(" 次）")), F.lit(""))
    tokens = F.coalesce(F.concat(F.lit(" · "), get("total_tokens"), F.lit(" tokens")), F.lit(""))
    rerun = F.lower(F.coalesce(F.get_json_object("payload", "$.request_rerun"), F.lit(""))) == "true"
    severity = F.coalesce(F.concat(F.lit("（"), get("severity"), F.lit("）")), F.lit(""))
    more = {
        "phase.changed": F.coalesce(F.concat(F.lit("进入 "), name), F.lit("切换到下一阶段")), "stage.started": F.coalesce(F.concat(stage, F.lit(" 开始")), F.lit("阶段开始")),
        "stage.completed": F.coalesce(F.concat(stage, F.lit(" 完成")), F.lit("阶段完成")), "stage.failed": F.concat(or_(stage, "阶段"), F.lit(" 失败："), unknown),
        "review.completed": F.when(rerun, F.concat(F.lit("Supervisor 复核完成，建议重跑 "), stages("rerun_stage_nums"))).otherwise("Supervisor 复核完成"),
        "rerun.requested": F.concat(F.lit("复核请求重跑 "), stages("stage_nums")), "stage.reset_for_rerun": F.concat(F.lit("已重置 "), stages("stage_nums"), F.lit("，准备重跑")),
        "agent.started": F.concat(role, F.lit(" 开始"), attempt), "agent.completed": F.concat(role, F.lit(" 完成"), tokens), "agent.failed": F.concat(role, F.lit(" 失败："), unknown),
        "finding.created": F.coalesce(F.concat(F.lit("发现新漏洞："), get("title"), severity), F.lit("写入新漏洞")), "finding.filtered": F.coalesce(F.concat(F.lit("过滤候选："), get("title")), F.lit("过滤候选发现")),
        "artifact.written": F.when(get("artifact_path", "path").isNotNull(), F.concat(or_(stage, "阶段"), F.lit("产物已写入"))).otherwise("写入阶段产物"),
        "worker.timeout": F.concat(F.lit("Worker 超时："), or_(get("message", "error_message"), "任务超时")),
    }
    for name_, told in more.items():
        out = out.when(kind == name_, told)
    return out.otherwise(or_(get("message"), ""))
