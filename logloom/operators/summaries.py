"""Work summaries, next actions and decisions by explicit rules, and the choice of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.keys import limit_text, stripped, topic_key

# The patterns of the rules, and the lengths of what they give.
DONE = r"実装|作成|追加|更新|修正|変更|対応|完了|成功|通過|確認|コミット|導入|反映"
RESULT = r"しました|しました。|済み|完了|成功|通過|確認できました|反映しました|追加しました|実装しました"
FAILED = r"失敗|未完了|中断|できません|エラー|保留"
GENERIC = r"^(?:対応|実装|作業|修正|変更)?(?:しました|完了しました|済みです)[。.!！]?$"
CHECKED = r"(?i)テスト|検証|確認|ビルド|コンパイル|lint|成功|通過"
FENCED = r"(?ms)^[ \t]*```[^\r\n]*\r?\n.*?(?:^[ \t]*```[ \t]*$|\z)"
PREFIX = r"(?U)^\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+)"
HEADING = r"(?U)^(?:対応内容|実施内容|結果|変更内容)\s*[:：]\s*"
TITLE_LENGTH, SHORT_LENGTH, DETAIL_LENGTH, ITEM_LENGTH, ITEMS = 80, 160, 500, 200, 5
NEXT = (
    r"(?U)(?:次に行う|次の)(?:作業|タスク)\s*(?:は|[:：])\s*[「『\"']?([^\r\n。！？!?」』\"']+)",
    r"(?U)次\s*は\s*[「『\"']?([^\r\n。！？!?」』\"']+)",
    r"(?iU)(?:Next task|Next action)\s*[:：]\s*[\"']?([^\r\n.!?\"']+)",
)
AMBIGUOUS = r"案\s*[A-Za-z0-9一二三四五六七八九十]+|提案|推奨|そのまま|それ以外|こちら|上記|前述|先ほど|問題ありません"
TRIGGER = r"採用|とします|にします|必須|使用します|使います|取り下げ|採用しません|不要です|対応しません|固定します|変更します"
REASON = r"(?U)^(.+?(?:ため|ので))[、,]\s*(.+)$"
SUBJECT = r"(?U)^([^。！？!?：:]{1,100}?)(?:は|については)\s*(.+?)(?:を採用します|とします|にします|を使用します|を使います|を必須とします|で固定します)$"
CHOICE = r"^(.+?)(?:を採用します|とします|を使用します|を使います|を必須とします|で固定します)$"
REJECTED = r"^(.+?)(?:を採用しません|は採用しません|を取り下げます|は不要です|には対応しません)$"
DECISION_LENGTH = 120


def clean_text(c: Column) -> Column:
    """Without fenced code and outer white space."""
    return stripped(F.regexp_replace(c, FENCED, ""))


def text_lines(c: Column) -> Column:
    return F.split(c, r"\r\n|[\n\r]")


def plain_text(c: Column) -> Column:
    """Lines without their Markdown prefix, those left joined by spaces."""
    bare = F.transform(text_lines(clean_text(c)), lambda x: stripped(F.regexp_replace(x, PREFIX, "")))
    return F.array_join(F.filter(bare, lambda x: x != ""), " ")


def bullets(c: Column) -> Column:
    items = F.filter(text_lines(c), lambda x: x.rlike(r"(?U)^\s*[-*+]\s+\S"))
    return F.transform(items, lambda x: limit_text(stripped(F.regexp_replace(x, PREFIX, "")), ITEM_LENGTH))


def result_sentence(text: Column, status: Column) -> Column:
    """The first sentence that tells a result of a completed turn, or the failure of a failed or
    incomplete one, and is no generic phrase; null without any."""
    cut = F.transform(F.split(plain_text(text), r"(?U)(?<=[。！？!?])\s+|[\r\n]+"), stripped)
    told = F.filter(cut, lambda s: (s != "") & ~s.rlike(GENERIC))
    good, bad = F.filter(told, lambda s: s.rlike(DONE) & s.rlike(RESULT)), F.filter(told, lambda s: s.rlike(FAILED))
    return F.when(status == "completed", F.try_element_at(good, F.lit(1))).when(status.isin("failed", "incomplete"), F.try_element_at(bad, F.lit(1)))


def explicit_summary(text: Column, status: Column) -> Column:
    """struct<title, summary, details, highlights, verification, confidence> of a message that tells
    its turn's outcome (see result_sentence), with up to five bullets of each sort; else null."""
    clean = clean_text(text)
    told = result_sentence(clean, status)
    items, details = bullets(clean), limit_text(plain_text(clean), DETAIL_LENGTH)
    title = limit_text(F.regexp_replace(F.regexp_replace(told, r"[。.!！]+$", ""), HEADING, ""), TITLE_LENGTH)
    checked, others = F.filter(items, lambda b: b.rlike(CHECKED)), F.filter(items, lambda b: ~b.rlike(CHECKED))
    made = F.struct(
        title.alias("title"), limit_text(told, SHORT_LENGTH).alias("summary"), F.when(details != "", details).otherwise(limit_text(told, DETAIL_LENGTH)).alias("details"),
        F.slice(others, 1, ITEMS).alias("highlights"), F.slice(checked, 1, ITEMS).alias("verification"), F.when(status == "completed", "high").otherwise("medium").alias("confidence"),
    )
    return F.when(told.isNotNull(), made)


def summary_source(messages: DataFrame, by: list[str], order: str, text: str, role: str, phase: str, status: str) -> DataFrame:
    """by and summary: of a turn's last message that tells its outcome, among its final answers, or
    without any among all but its commentary."""
    final = F.coalesce(F.col(phase) == "final_answer", F.lit(False))
    rows = messages.where((F.col(role) == "assistant") & ~F.coalesce(F.col(phase) == "commentary", F.lit(False)))
    rows = rows.withColumn("_any", F.max(final).over(Window.partitionBy(*by))).where(~F.col("_any") | final)
    told = rows.withColumn("summary", explicit_summary(F.col(text), F.col(status))).where("summary is not null")
    return told.groupBy(*by).agg(F.max_by("summary", order).alias("summary"))


def with_notice(summary: Column, rolled_back: Column, notice: str = " (rolled back)", most: int = 500) -> Column:
    return F.when(F.coalesce(rolled_back, F.lit(False)), F.concat(limit_text(summary, most - len(notice)), F.lit(notice))).otherwise(limit_text(summary, most))


def next_task_phrase(text: Column) -> Column:
    """What the first pattern that fits names as the next task; null without any."""
    found = [F.regexp_replace(F.regexp_extract(text, p, 1), r"^[ \t:：\-—]+|[ \t:：\-—]+$", "") for p in NEXT]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def next_task(messages: DataFrame, by: list[str], order: str, text: str, cached: DataFrame | None = None) -> DataFrame:
    """Per group one row, by, task, route: explicit (of its newest message that names a next task),
    else cache (by, task), else fallback with a null task."""
    rows = messages.withColumn("_task", next_task_phrase(F.col(text)))
    found = rows.groupBy(*by).agg(F.max_by("_task", F.when(F.col("_task").isNotNull(), F.col(order))).alias("_explicit"))
    if cached is not None:
        found = found.join(cached.select(*by, F.col("task").alias("_cached")), by, "left")
    else:
        found = found.withColumn("_cached", F.lit(None).cast("string"))
    route = F.when(F.col("_explicit").isNotNull(), "explicit").when(F.col("_cached").isNotNull(), "cache").otherwise("fallback")
    return found.select(*by, F.coalesce("_explicit", "_cached").alias("task"), route.alias("route"))


def statements(text: Column) -> Column:
    """Sentences for decisions: cut at full stops and line ends, without bullets and heading marks."""
    cut = F.transform(F.split(text, r"[。！？!?]+|\r?\n"), lambda s: F.regexp_replace(s, r"^[ \t\r\n・\-*#]+|[ \t\r\n・\-*#]+$", ""))
    return F.filter(cut, lambda s: s != "")


def states_decision(text: Column) -> Column:
    """Whether a text has the words of a decision, and none that point to what was said before."""
    return text.rlike(TRIGGER) & ~text.rlike(AMBIGUOUS)


def decision_proposals(text: Column) -> Column:
    """array<struct<topic, choice, status, reason, title, description>> of a text's sentences that
    state a decision: a rejected choice, else a subject with its choice, else an adopted choice."""
    def one(s: Column) -> Column:
        reasoned = s.rlike(REASON)
        reason = F.when(reasoned, stripped(F.regexp_extract(s, REASON, 1)))
        body = F.when(reasoned, stripped(F.regexp_extract(s, REASON, 2))).otherwise(s)
        no, about = body.rlike(REJECTED), body.rlike(SUBJECT)
        subject = stripped(F.regexp_extract(body, SUBJECT, 1))
        choice = stripped(F.when(no, F.regexp_extract(body, REJECTED, 1)).when(about, F.regexp_extract(body, SUBJECT, 2)).otherwise(F.regexp_extract(body, CHOICE, 1)))
        about = about & ~no
        title = F.when(about, F.concat(subject, F.lit(": "), choice)).otherwise(choice)
        status = F.when(no, "rejected").when(about | body.rlike(CHOICE), "adopted")
        return F.struct(topic_key(F.when(about, subject).otherwise(choice)).alias("topic"), choice.alias("choice"), status.alias("status"), reason.alias("reason"), limit_text(title, DECISION_LENGTH).alias("title"), body.alias("description"))

    return F.filter(F.transform(statements(text), one), lambda d: d["status"].isNotNull())


def seeded_decisions(history: DataFrame, proposals: DataFrame, order: list[str]) -> DataFrame:
    """History and new proposals in one table for versions.supersede_chain: restored rows come
    before all new ones, in their own order; seed tells which they are."""
    place = F.struct(*order)
    both = history.withColumn("seed", F.lit(True)).unionByName(proposals.withColumn("seed", F.lit(False)))
    return both.withColumn("place", F.struct((~F.col("seed")).alias("new"), place.alias("at")))


def summary_route(turns: DataFrame, cached: DataFrame, explicit: DataFrame, key: list[str]) -> DataFrame:
    """turns with summary and route: the cached one, else the explicit one, else pending with null."""
    out = turns.join(cached.select(*key, F.col("summary").alias("_cached")), key, "left").join(explicit.select(*key, F.col("summary").alias("_explicit")), key, "left")
    route = F.when(F.col("_cached").isNotNull(), "cache").when(F.col("_explicit").isNotNull(), "explicit").otherwise("pending")
    return out.withColumns({"summary": F.coalesce("_cached", "_explicit"), "route": route}).drop("_cached", "_explicit")


def combined_eligibility(status: Column, incremental: Column, masked: Column, sufficient: Column, has_candidate: Column, cross_turn: Column) -> Column:
    """Why a turn's results are not to be inferred together, the first reason that holds; null if
    they are."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(status == "in_progress", "turn_in_progress")
        .when(no(incremental), "turn_not_incremental")
        .when(no(masked), "inference_input_not_masked")
        .when(yes(sufficient), "rule_based_sufficient")
        .when(no(has_candidate), "next_task_context_missing")
        .when(yes(cross_turn), "cross_turn_context")
    )


def short_nonchange(texts: Column, changed: Column, referenced: Column, lexicon: list[str], most: int = 120) -> Column:
    """Whether a turn changed nothing, names no file, and says but phrases of the lexicon, compared
    without spaces and stops, in no more than `most` characters."""
    bare = F.transform(texts, lambda t: F.regexp_replace(t, r"(?U)[\s。！？!?、,]+", ""))
    total = F.aggregate(bare, F.lit(0), lambda n, t: n + F.length(t))
    trivial = (F.size(bare) > 0) & (total <= most) & F.forall(bare, lambda t: t.isin(*lexicon) & (t != ""))
    return F.coalesce(~changed & ~referenced & trivial, F.lit(False))


def bounded_prompt(items: DataFrame, by: list[str], order: list[Column], text: str, budget: int = 65_536) -> DataFrame:
    """Per group its texts, in order, until one more would exceed the budget in UTF-8 bytes, as an
    array, and how many were left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = F.sum(F.octet_length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = items.withColumns({"_fits": upto <= budget, "_nth": F.row_number().over(w)})
    kept = F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("_nth", F.col(text).alias("text")))))
    return rows.groupBy(*by).agg(F.transform(kept, lambda x: x["text"]).alias("texts"), F.count_if(~F.col("_fits")).alias("left_out"))


def valid_results(results: Column, allowed: Column) -> Column:
    """Of results array<struct<status, title, description, reason, topic, evidence>> those of a known
    status, with a title, description and topic, whose evidence is among the allowed ids."""
    filled = lambda c: c.isNotNull() & (stripped(c) != "")
    def fine(r: Column) -> Column:
        return r["status"].isin("adopted", "rejected") & filled(r["title"]) & filled(r["description"]) & filled(r["topic"]) & (F.size(F.array_except(r["evidence"], allowed)) == 0)
    return F.filter(results, lambda r: F.coalesce(fine(r), F.lit(False)))


def within_calls(pending: DataFrame, order: list[Column], calls: int, by: list[str]) -> DataFrame:
    """Adds deferred: whether a row lies beyond the first `calls` of its run."""
    return pending.withColumn("deferred", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > calls)
