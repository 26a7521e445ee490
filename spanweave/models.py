"""Where a language model takes part: prompts are a column, replies come back beside them.

The engine has no model. ``complete`` runs a caller's function over prompts on the workers; ``json_object``
reads what a reply says; the steps below build prompts from a state and read replies into rows that
``locate`` then has to place, so that nothing a model says is taken without its quote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.functions.text import cited, keep_cited
from spanweave.operators.locate import ref
from spanweave.pipeline import State, register

_STATEMENTS = "array<struct<type:string,fields:map<string,string>,quote:string>>"
_RELATIONS = "array<struct<predicate:string,src:string,dst:string,quote:string>>"


def complete(prompts: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """Adds what ``model`` replies to each batch of prompts; a null prompt has a null reply. The function travels to the workers."""
    names = prompts.columns
    at = names.index(prompt)

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            asked = batch.column(at).to_pylist()
            said = iter(model([p for p in asked if p is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if p is None else next(said) for p in asked], pa.string())], names=[*names, reply])

    return prompts.mapInArrow(ask, T.StructType([*prompts.schema.fields, T.StructField(reply, T.StringType())]))


def json_object(reply: Column) -> Column:
    """The text of the outermost braces of a reply, null where there are none."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def parsed(reply: Column, key: str, shape: str) -> Column:
    """A key of the reply's object; empty where the reply is no such object."""
    return F.coalesce(F.from_json(json_object(reply), f"{key} {shape}")[key], F.array().cast(shape))


@dataclass(frozen=True)
class PromptOptions:
    instruction: str = ""


@register("extract_llm", ("segments", "model", "schema"), ("statements",), PromptOptions)
def extract(state: State, o: PromptOptions) -> State:
    """Statements of each segment: id, source_id, segment, type, fields, quote."""
    types = ", ".join(sorted(state["schema"].classes))
    text = state["segments"].withColumn("prompt", F.concat(F.lit(f'{o.instruction}\nTypes: {types}\nReply {{"statements": [{{"type", "fields", "quote"}}]}}\n\n'), "text"))
    said = complete(text, state["model"]).select("source_id", F.col("number").alias("segment"), F.explode(parsed(F.col("reply"), "statements", _STATEMENTS)).alias("s"))
    return {"statements": said.select(F.sha2(F.to_json(F.struct("source_id", "segment", "s")), 256).substr(1, 16).alias("id"), "source_id", "segment", "s.*")}


@register("relate_llm", ("segments", "nodes", "model", "schema"), ("relations",), PromptOptions)
def relate(state: State, o: PromptOptions) -> State:
    """Relations between a segment's nodes: id, predicate, source_id, segment, src_ref, dst_ref, quote."""
    shown = state["nodes"].select(F.element_at("spans", 1).alias("p"), "id", "type").select(F.col("p.source_id").alias("source_id"), F.col("p.segment").alias("number"), F.concat_ws(" ", ref(F.col("p.source_id"), F.col("id")), "type", "p.text").alias("line"))
    listed = shown.groupBy("source_id", "number").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("listed"))
    names = ", ".join(sorted(state["schema"].properties()))
    head = F.lit(f'{o.instruction}\nRelations: {names}\nReply {{"relations": [{{"predicate", "src", "dst", "quote"}}]}}\n')
    asked = state["segments"].join(listed, ["source_id", "number"]).withColumn("prompt", F.concat(head, "listed", F.lit("\n\n"), "text"))
    said = complete(asked, state["model"]).select("source_id", F.col("number").alias("segment"), F.explode(parsed(F.col("reply"), "relations", _RELATIONS)).alias("r"))
    digest = F.sha2(F.to_json(F.struct("source_id", "segment", "r")), 256).substr(1, 16)
    return {"relations": said.select(digest.alias("id"), "r.predicate", "source_id", "segment", F.col("r.src").alias("src_ref"), F.col("r.dst").alias("dst_ref"), "r.quote")}


@register("define_llm", ("candidates", "model"), ("candidates",), PromptOptions)
def define(state: State, o: PromptOptions) -> State:
    """Definitions of candidates that have none."""
    rows = state["candidates"]
    asked = rows.withColumn("prompt", F.when(F.coalesce(F.trim("definition"), F.lit("")) == "", F.concat(F.lit(o.instruction + "\nDefine in one sentence: "), "label")))
    return {"candidates": complete(asked, state["model"]).withColumn("definition", F.coalesce(F.trim("reply"), "definition")).select(rows.columns)}


@register("salience_llm", ("hits", "nodes", "question", "model"), ("hits",), PromptOptions)
def salience(state: State, o: PromptOptions) -> State:
    """Hits scored anew, from 0 to 1, by what the model makes of each beside the question."""
    text = state["nodes"].select(F.col("id").alias("node"), F.concat_ws("\n", F.map_values("fields")).alias("text"))
    asked = state["hits"].join(text, "node").withColumn("prompt", F.concat(F.lit(f"{o.instruction}\nQuestion: {state['question']}\nReply with a number from 0 to 1.\n\n"), "text"))
    score = F.expr("try_cast(regexp_extract(reply, '[01](?:[.][0-9]+)?', 0) as double)")
    return {"hits": complete(asked, state["model"]).select("node", F.coalesce(F.least(F.lit(1.0), score), F.lit(0.0)).alias("score"))}


@register("route", ("question", "model"), ("overview",), PromptOptions)
def route(state: State, o: PromptOptions) -> State:
    """Whether a question asks for an overview rather than a fact."""
    said = state["model"]([f"{o.instruction}\nReply overview or fact.\n\n{state['question']}"])[0]
    return {"overview": "overview" in said.lower()}


@register("answer", ("bundle", "refs", "question", "model"), ("answer", "citations"), PromptOptions)
def answer(state: State, o: PromptOptions) -> State:
    """An answer whose every line cites the package: other lines go. refs: node, ref, text."""
    spark, held = state["spark"], state["refs"].join(state["bundle"].nodes.select("node", "reason"), "node")
    lines = [f"[{r['ref']}] {r['text']} ({r['reason'] or ''})" for r in held.orderBy("ref").collect()]  # a package is bounded
    said = state["model"](["\n".join([o.instruction, f"Question: {state['question']}", "Cite as [ref] in every line.", *lines])])[0]
    known = [r["ref"] for r in held.select("ref").collect()]
    row = spark.createDataFrame([(said, known)], "text string, known array<string>").select(keep_cited(F.col("text"), F.col("known")).alias("text"))
    return {"answer": row.first()["text"], "citations": row.select(F.explode(cited(F.col("text"))).alias("ref")).distinct()}
