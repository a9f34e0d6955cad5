"""Read-only agent: a plan of three to six questions, evidence per step, a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.functions.text import rationale, sentences

# Questions that fill a short plan, with their reasons.
FALLBACKS = (
    ("这个仓库的主要模块结构和入口文件是什么？", "先了解整体架构，便于把任务定位到具体模块"),
    ("实现这个任务涉及哪些关键文件和函数？", "找出实现任务最相关的核心符号，避免大面积改动"),
    ("现有代码中是否有可复用的工具函数或类？", "避免重复造轮子，优先复用已有抽象"),
    ("改动可能影响哪些调用方或上下游？", "评估改动面，提早识别回归风险"),
    ("如何验证改动的正确性？需要运行哪些测试？", "给出可执行的测试 / 验证命令"),
    ("是否存在潜在的边界条件或异常路径？", "覆盖边界场景，避免遗漏健壮性处理"),
)
LEAST, MOST, KEY_FILES = 3, 6, 8


def plan(tasks: DataFrame) -> DataFrame:
    """task_id, pos, question, rationale, understanding from task_id, task. Short plans are filled in the row itself: no join."""
    own = F.transform(sentences(F.col("task")), lambda s: F.struct(s.alias("question"), rationale(s).alias("rationale")))
    spare = F.array(*[F.struct(F.lit(q).alias("question"), F.lit(r).alias("rationale")) for q, r in FALLBACKS])
    steps = tasks.select("task_id", "task", own.alias("own"))
    fill = F.filter(spare, lambda f: ~F.exists("own", lambda o: o["question"] == f["question"]))
    full = F.when(F.size("own") < LEAST, F.slice(F.concat("own", fill), 1, LEAST)).otherwise(F.slice("own", 1, MOST))
    steps = steps.select("task_id", "task", full.alias("steps"))
    t = F.regexp_replace("task", "^\\s+|\\s+$", "")
    short = F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 77), F.lit("..."))).otherwise(t)
    told = F.concat(F.lit("用户任务："), short, F.lit("（拆解为 "), F.size("steps").cast("string"), F.lit(" 个子问题）"))
    return steps.select("task_id", told.alias("understanding"), F.posexplode("steps").alias("pos", "s")).select("task_id", "pos", "s.question", "s.rationale", "understanding")


def key_files(evidence: DataFrame) -> DataFrame:
    """task_id, file_path, steps, rank: files by the number of steps that found them, then by who came first."""
    per = evidence.groupBy("task_id", "file_path").agg(F.countDistinct("pos").alias("steps"), F.min(F.struct("pos", "rank")).alias("first"))
    order = W.partitionBy("task_id").orderBy(F.col("steps").desc(), "first.pos", "first.rank", "file_path")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= KEY_FILES).select("task_id", "file_path", "steps", "rank")


def references(evidence: DataFrame) -> DataFrame:
    """task_id, refs: distinct files over all steps in order of their first place."""
    first = evidence.groupBy("task_id", "file_path").agg(F.min(F.struct("pos", "rank")).alias("f"))
    return first.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("f", "file_path"))).alias("a")).select("task_id", F.array_join(F.col("a.file_path"), ",").alias("refs"))


def insufficient(steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """task_id, insufficient: no step of the plan has a hit."""
    found = evidence.select("task_id").distinct().withColumn("found", F.lit(True))
    return steps.select("task_id").distinct().join(found, "task_id", "left").select("task_id", F.col("found").isNull().alias("insufficient"))


def hit_line() -> Column:
    """A hit in one line: where it stands, and what it is."""
    return F.format_string("%s:%d-%d  %s=%s", F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_type"), F.when(F.coalesce("name", F.lit("")) == "", "<anonymous>").otherwise(F.col("name")))


# What a brief says.
CHANGE, NO_CHANGE = "处理子问题：", "无具体子问题，可直接基于现有代码修改"
RISK_NONE, RISK_FEW, RISK_CHANGE = "证据不足：检索未命中任何代码片段，建议人工补充上下文", "命中的关键文件较少，可能存在理解偏差", "任务涉及改动，注意回归测试与兼容性"
CHANGE_WORDS, SPEED_WORDS = ("重构", "修改", "替换", "删除"), ("性能", "performance", "perf")
TEST, TEST_SPEED = "python -m pytest tests/ -v", "# 性能相关：考虑补 benchmark / 性能基线"
NOTE_NONE, NOTE_FOUND = "证据不足，未自动生成完整方案；建议重新索引后重试，或补充任务描述", "已交叉验证检索证据；建议人工复核引用到的关键文件"


def briefs(steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """What the evidence of a task comes to, a row a task: understanding, suggested_changes, key_files, risks, suggested_tests,
    insufficient_evidence, review_note. steps: as plan() gives them (at most MOST a task). evidence: as for key_files()."""
    told = steps.groupBy("task_id").agg(F.first("understanding").alias("understanding"), F.array_sort(F.collect_list(F.struct("pos", "question"))).alias("s"))
    files = key_files(evidence).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path"))).alias("f"))
    both = told.join(files, "task_id", "left").withColumn("key_files", F.coalesce(F.col("f.file_path"), F.array().cast("array<string>")))
    asked = F.filter(F.col("s.question"), lambda q: q != "")
    changes = F.when(F.size(asked) == 0, F.array(F.lit(NO_CHANGE))).otherwise(F.transform(asked, lambda q: F.concat(F.lit(CHANGE), q)))
    none = F.size("key_files") == 0
    speed = F.exists(F.col("s.question"), lambda q: F.lower(q).rlike("|".join(SPEED_WORDS)))
    risks = F.array(F.when(none, RISK_NONE).when(F.size("key_files") < 2, RISK_FEW), F.when(F.col("understanding").rlike("|".join(CHANGE_WORDS)), RISK_CHANGE))
    return both.select(
        "task_id", "understanding", changes.alias("suggested_changes"), "key_files", F.array_compact(risks).alias("risks"),
        F.array_compact(F.array(F.lit(TEST), F.when(speed, TEST_SPEED))).alias("suggested_tests"), none.alias("insufficient_evidence"), F.when(none, NOTE_NONE).otherwise(NOTE_FOUND).alias("review_note"),
    )


def report(task: str, steps: DataFrame, hits: DataFrame) -> dict:
    """The report of one task: its plan, evidence and brief. hits: task_id, pos, rank, file_path and the chunk's columns."""
    evidence = hits.select("task_id", "pos", "rank", "file_path")
    brief = briefs(steps, evidence).first().asDict()
    rows, found = steps.orderBy("pos").collect(), hits.select("pos", "rank", "file_path", hit_line().alias("line")).orderBy("pos", "rank").collect()
    mine = lambda pos, c: list(dict.fromkeys(r[c] for r in found if r["pos"] == pos))
    return {
        "task": task, **{k: v for k, v in brief.items() if k != "task_id"}, "plan": [{"question": r["question"], "rationale": r["rationale"]} for r in rows],
        "references": list(dict.fromkeys(r["line"] for r in found)),
        "evidence": [{"question": r["question"], "file_paths": mine(r["pos"], "file_path"), "chunk_summaries": mine(r["pos"], "line")} for r in rows],
    }
