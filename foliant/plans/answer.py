"""Answering a table of questions: one half before the model, one half after it.

The model itself runs elsewhere: the first half gives a table of prompts, the second takes a table of answers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.guard import (canary, check_output, classify_question, context_block, redact_pii, redact_secrets, screen_input,
                               strip_reasoning, valid_image_ref)
from ..functions.vectors import Embedder
from ..operators.embed import embed
from ..operators.prompt import (PromptTexts, accept_rewrites, clean_history, collect_flags, messages, prepare_passages, rewrite_requests, scrub_removed,
                                serious_flags, source_rows, suspicious_questions, system_prompt, used_sources)
from ..operators.retrieve import hybrid_search, overview
from ..session import staged


@dataclass
class Asked:
    """First half: all questions with flags, and for the admitted ones hits, prompts and messages (both in ``prompts``)."""

    questions: DataFrame
    hits: DataFrame
    prompts: DataFrame


def screen_questions(questions: DataFrame, *, pii: bool = False, mode: str = "block", assistant_name: str | None = None) -> DataFrame:
    """Screen, redact and classify questions (qid, org, query, ...): adds ``allowed``, ``reason``, ``flags``, the kinds."""
    screened = screen_input(questions, "query", "__v", mode=mode).withColumn("query", F.col("__v.text"))
    safe = redact_secrets(screened, "query", found="__secrets")
    if pii:
        safe = redact_pii(safe, "query", found="__pii")
    found = F.size("__pii") > 0 if pii else F.lit(False)
    allowed = F.col("__v.allowed")
    flags = collect_flags((F.col("__v.flags"), None), (~allowed, "input_blocked"), (allowed & (F.size("__secrets") > 0), "secret_in_input"),
                          (allowed & found, "pii_redacted"))
    judged = safe.withColumns({"allowed": allowed, "reason": F.col("__v.reason"), "flags": flags})
    return classify_question(judged.drop("__v", "__secrets", "__pii"), "query", assistant_name=assistant_name)


def retrieve_routed(chunks: DataFrame, questions: DataFrame, catalogues: DataFrame, model: Embedder, *, k: int = fv.DEFAULT_K) -> DataFrame:
    """Hits of classified questions: none for questions about the assistant or the library, or if the library is empty;
    hybrid search otherwise; opening passages for broad questions the search finds nothing for."""
    routed = questions.where("allowed AND NOT is_identity AND NOT is_library").join(catalogues.select("org"), "org", "left_semi")
    search = F.coalesce("search_query", "query") if "search_query" in questions.columns else F.col("query")
    asked = staged(embed(routed.withColumn("query", search), model, "query", "qvec"), "asked")
    found = staged(hybrid_search(chunks, asked, model.name, k=k), "hits")
    broad = routed.where("is_overview").join(found.select("qid").distinct(), "qid", "left_anti")
    return found.unionByName(overview(chunks, broad, k=k))


def safe_history(questions: DataFrame, turns: DataFrame, removed: DataFrame, *, pii: bool = False) -> DataFrame:
    """``qid, org, turn, role, content``: what of earlier turns (qid, turn, role, content) may be shown to a model."""
    cleaned = clean_history(turns.select("qid", "turn", "role", "content"), pii=pii).join(questions.select("qid", "org"), "qid")
    return scrub_removed(cleaned, removed)


def rewrites_wanted(questions: DataFrame, turns: DataFrame, removed: DataFrame, *, pii: bool = False, mode: str = "block", assistant_name: str | None = None) -> DataFrame:
    """``qid, query, rewrite_text`` of the questions that follow earlier turns and will be searched for: what a model outside is to rewrite."""
    judged = screen_questions(questions, pii=pii, mode=mode, assistant_name=assistant_name).where("allowed AND NOT is_identity AND NOT is_library")
    return rewrite_requests(judged, safe_history(judged, turns, removed, pii=pii)).where("rewrite_text IS NOT NULL")


def refuse_images(judged: DataFrame) -> DataFrame:
    """Refuse admitted questions with an image that cannot be read; what was flagged until then stays."""
    bad = F.col("allowed") & F.col("image").isNotNull() & ~F.coalesce(valid_image_ref(F.col("image")), F.lit(False))
    return judged.withColumn("__bad", bad).withColumns({
        "reason": F.when(F.col("__bad"), fv.BAD_IMAGE).otherwise(F.col("reason")), "allowed": F.col("allowed") & ~F.col("__bad"),
        "flags": collect_flags((F.col("flags"), None), (F.col("__bad"), "bad_image"))}).drop("__bad")


def prompt_questions(chunks: DataFrame, questions: DataFrame, catalogues: DataFrame, removed: DataFrame, model: Embedder, *,
                     key: str, k: int = fv.DEFAULT_K, pii: bool = False, mode: str = "block", texts: PromptTexts = PromptTexts(),
                     assistant_name: str | None = None, turns: DataFrame | None = None, replies: DataFrame | None = None) -> Asked:
    """Screen, rewrite, route, search and write prompts and messages.

    ``catalogues``: org, catalogue, listed; ``removed``: org, name, id. ``turns`` (qid, turn, role, content) are what was said before, ``replies`` (qid, reply)
    what a model made of :func:`rewrites_wanted`; questions without a usable reply are searched for as they are.
    """
    judged = screen_questions(questions, pii=pii, mode=mode, assistant_name=assistant_name)
    history = None
    if turns is not None:
        history = staged(safe_history(judged.where("allowed"), turns, removed, pii=pii), "history")
        usable = judged.select("qid").limit(0).withColumn("reply", F.lit(None).cast("string")) if replies is None else replies
        judged = accept_rewrites(judged, usable.join(history.select("qid").distinct(), "qid", "left_semi"))
    judged = staged(judged, "questions")
    hits = staged(retrieve_routed(chunks, judged, catalogues, model, k=k), "hits")
    flags = collect_flags((F.col("flags"), None), (F.coalesce("suspicious_hits", F.lit(False)), "suspicious_document_content"))
    judged = judged.join(suspicious_questions(hits), "qid", "left").withColumn("flags", flags).drop("suspicious_hits")
    if "image" in questions.columns:
        judged = refuse_images(judged)
    context = context_block(prepare_passages(hits, pii=pii), ["qid"])
    newest = removed.withColumn("n", F.row_number().over(Window.partitionBy("org").orderBy(F.desc("id")))).where(F.col("n") <= fv.REMOVED_IN_PROMPT)
    gone = newest.groupBy("org").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("r"))
    gone = gone.select("org", F.transform("r", lambda x: x["name"]).alias("removed"))
    admitted = (judged.where("allowed").withColumn("canary", canary(F.col("qid"), key)).join(catalogues, "org", "left")
                .join(gone, "org", "left").join(context, "qid", "left"))
    restricted = F.col("document_ids").isNotNull() if "document_ids" in questions.columns else F.lit(False)
    carried = [c for c in ("search_query", "image") if c in judged.columns]
    prompts = admitted.withColumn("restricted", restricted).select(
        "qid", "org", "query", *carried, "canary", "flags", system_prompt(texts).alias("prompt"))
    none = prompts.select("qid", F.lit(0).alias("turn"), F.lit("").alias("role"), F.lit("").alias("content")).limit(0)
    written = messages(prompts, none if history is None else history)
    return Asked(judged, hits, prompts.join(written, "qid"))


def finish_answers(asked: Asked, answers: DataFrame, *, pii: bool = False) -> tuple[DataFrame, DataFrame]:
    """Checked answers (qid, org, answer, flags, blocked, status, serious) of all questions, and their source rows.

    A question the screening refused is answered by the reason. ``answers`` (qid, answer) may have a ``status``, set where the model failed: such a question has no
    answer, no flags and no sources.
    """
    status = F.col("status").cast("int") if "status" in answers.columns else F.lit(None).cast("int")
    met = asked.prompts.join(answers.select("qid", strip_reasoning(F.col("answer")).alias("raw"), status.alias("status")), "qid")
    checked = check_output(met.where("status IS NULL"), "raw", "canary").withColumns({
        "answer": F.col("checked.text"), "flags": F.concat("flags", "checked.flags")})
    good = checked.select("qid", "org", "answer", "flags", F.lit(False).alias("blocked"), "status")
    failed = met.where("status IS NOT NULL").select(
        "qid", "org", F.lit(None).cast("string").alias("answer"), F.array().cast("array<string>").alias("flags"), F.lit(False).alias("blocked"), "status")
    refused = asked.questions.where("NOT allowed").select(
        "qid", "org", F.col("reason").alias("answer"), "flags", F.lit(True).alias("blocked"), F.lit(None).cast("int").alias("status"))
    final = good.unionByName(failed).unionByName(refused).withColumn("serious", serious_flags(F.col("flags")))
    return final, source_rows(used_sources(asked.hits, good), pii=pii)


def audit_events(final: DataFrame, ts) -> DataFrame:
    """Audit events of failed, blocked and seriously flagged questions: org, ts, action, target, detail (JSON)."""
    action = (F.when(F.col("status").isNotNull(), "chat.error").when(F.col("blocked"), "chat.blocked").when(F.size("serious") > 0, "chat.flagged"))
    named = final.withColumn("action", action).where("action IS NOT NULL")
    flags = F.when(F.col("blocked"), F.col("flags")).otherwise(F.col("serious"))
    detail = F.when(F.col("status").isNotNull(), F.to_json(F.struct("status"))).otherwise(F.to_json(F.struct(flags.alias("flags"))))
    return named.select("org", F.lit(ts).alias("ts"), "action", F.lit("").alias("target"), detail.alias("detail"))
