"""The whole way from documents to results, as tables of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import markup
from gristmill.functions import text as T
from gristmill.functions.batches import sliced
from gristmill.operators import artifacts, chunking, grounding, outcomes, pdf, tasks
from gristmill.operators.dispatch import Options, Provider, dispatched

from .tables import Written

SCHEMA = "path string, type string, enum_values array<string>, description string, required boolean, inference_type string"
NOT_BUILT = "pdf content-prep not implemented without an injected text extractor"
STORAGE = "prepared artifact storage failed; exact text is unavailable from the configured store"
IMAGES = ("png", "jpeg")
#: What an injected extractor of bytes returns: a dict (text, page_offsets, layout, warnings), or it raises.
Reader = Callable[[bytes], dict]
_READ = f"text:string,page_offsets:array<bigint>,layout:{pdf.LAYOUT},warnings:array<string>,error:string"


def _read(readers: dict[str, Reader], most: int):
    """The column function of (label, bytes) that runs the label's extractor on the bytes; a failure is an error in the row. Without a label, the row is null."""

    def one(label, data) -> dict | None:
        if label is None:
            return None
        if data is None:
            return {"error": f"{label} content-prep requires bytes, not a string"}
        try:
            got = readers[label](data)
            if not isinstance(got, dict) or not isinstance(got.get("text"), str):
                return {"error": f"{label} text extraction failed: extractor returned no text"}
        except Exception as e:  # an extractor may fail in any way
            return {"error": f"{label} text extraction failed: {e}"}
        notes = got.get("warnings")
        if notes is None:
            notes = []
        elif not isinstance(notes, list) or not all(isinstance(x, str) for x in notes):
            notes = [pdf.DROPPED_WARNINGS]
        offsets = got.get("page_offsets")
        if offsets is not None and not (isinstance(offsets, list) and all(isinstance(x, int) and not isinstance(x, bool) for x in offsets)):
            offsets, notes = None, [*notes, pdf.DROPPED_OFFSETS]
        return {"text": got["text"][:most], "page_offsets": offsets, "layout": got.get("layout"), "warnings": notes}

    return sliced(lambda labels, data: [one(k, x) for k, x in zip(labels, data)], f"struct<{_READ}>")


def prepared(
    docs: DataFrame, prep: str | None = None, size: int = chunking.SIZE, most: int | None = chunking.MOST, pdf_text: Reader | None = None, image_text: Reader | None = None,
    version: str = artifacts.PREPARATION_VERSION,
) -> DataFrame:
    """`docs` (run_id, source_ref, content, content_type, maybe content_bytes and snapshot_ref) with full_text, pieces (text, start, end; null: windows), card_count, truncated, mode, embedded,
    page_offsets, layout, ocr_derived, warnings, error, artifact.

    html becomes Markdown, in cards if there are three like ones, or text if prep is `text` or the tree can't be converted; transcripts are cleaned; text stays. Bytes of PDFs and images go through
    the injected extractor, whose sidecars are dropped whole if a member is wrong.
    """
    for name, kind in (("content_bytes", "binary"), ("snapshot_ref", "string")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    kind, c, data = F.col("content_type"), F.col("content"), F.col("content_bytes")
    html, is_pdf, is_image = kind == "html", kind == "pdf", kind.isin(*IMAGES)
    wants_tree = html & (F.lit(prep or "markdown") == "markdown")
    rows = docs.select("run_id", "source_ref", "content_type", "content", "content_bytes", "snapshot_ref")
    rows = rows.withColumn("page", F.when(html & c.isNotNull(), markup.page(F.when(html, c), size, most)))
    readers = {k: f for k, f in (("pdf", pdf_text), ("image", image_text)) if f is not None}
    label = F.when(is_pdf if pdf_text is not None else F.lit(False), "pdf").when(is_image if image_text is not None else F.lit(False), "image")
    rows = rows.withColumn("read", _read(readers, T.FULL_CHARS)(label, F.when(label.isNotNull(), data)) if readers else F.lit(None).cast(f"struct<{_READ}>"))
    through = (is_pdf if pdf_text is not None else F.lit(False)) | (is_image if image_text is not None else F.lit(False))
    tree = wants_tree & F.col("page.problem").isNull()
    mode = F.when(through & is_pdf, "pdf-text").when(through, "image-ocr").when(tree, "markdown").when(kind == "transcript", "transcript").otherwise("text")
    error = F.when(through, F.col("read.error")).when(c.isNull(), F.concat(F.lit('binary content is not supported for contentType "'), kind, F.lit('"; provide a string'))).when(is_pdf, NOT_BUILT)
    text = (
        F.when(through, F.col("read.text")).when(tree, F.col("page.cards.full_text")).when(html, T.html_to_text(c, T.FULL_CHARS)).when(kind == "transcript", T.vtt_to_text(c, T.FULL_CHARS))
        .otherwise(F.substring(c, 1, T.FULL_CHARS))
    )
    rows = rows.withColumns({"mode": mode, "error": error, "full_text": F.when(error.isNull(), text)})
    structural = (F.col("mode") == "markdown") & F.col("page.cards.structural")
    state = F.col("page.state")
    has_state = (F.size(state["json_ld"]) > 0) | state["next_data"].isNotNull() | state["initial_state"].isNotNull()
    # a text whose offsets or layout aren't in it loses them all
    offsets, layout = pdf.valid_offsets(F.col("read.page_offsets"), F.col("full_text")), pdf.valid_layout(F.col("read.layout"), F.col("full_text"))
    rows = rows.withColumns({"page_offsets": offsets, "layout": F.when(F.col("read.layout").isNotNull(), layout), "shell": F.when(html, T.shell_signals(c, F.col("full_text"), F.coalesce(has_state, F.lit(False)))["warning"])})
    empty = F.array().cast("array<string>")
    notes = F.concat(
        F.coalesce("read.warnings", empty),
        F.array_compact(
            F.array(
                F.when(F.col("read.page_offsets").isNotNull() & F.col("page_offsets").isNull(), pdf.DROPPED_OFFSETS), F.when(F.col("read.layout").isNotNull() & F.col("layout").isNull(), pdf.DROPPED_LAYOUT),
                F.when(wants_tree & F.col("page.problem").isNotNull(), F.concat(F.lit("markdown/structural prep failed ("), F.col("page.problem"), F.lit("); fell back to text chunking"))),
            )
        ),
        F.coalesce(state["warnings"], empty), F.array_compact(F.array("shell")),
    )
    return rows.select(
        "run_id", "source_ref", "snapshot_ref", "content_type", "mode", "full_text", F.when(structural, F.col("page.cards.chunks")).alias("pieces"),
        F.when(structural, F.col("page.cards.card_count")).otherwise(0).alias("card_count"), F.when(structural, F.col("page.cards.truncated")).otherwise(0).alias("truncated"),
        F.when(html & has_state, state.dropFields("warnings")).alias("embedded"), "page_offsets", "layout", (F.col("mode") == "image-ocr").alias("ocr_derived"),
        F.when(F.col("error").isNull(), notes).otherwise(empty).alias("warnings"), "error",
        F.when(F.col("error").isNull(), artifacts.artifact(F.col("full_text"), F.col("mode"), F.col("snapshot_ref"), version)).alias("artifact"),
    )


def chunked(prep: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, most: int | None = chunking.MOST, blank: bool = False) -> DataFrame:
    """(run_id, content_type, chunk_idx, start, end, chunk, n_chunks, truncated_chunks): the cards of a page, or windows; of an empty text one empty window if `blank`, else none."""
    ok = prep.where("error is null")
    cards = ok.where("pieces is not null").select("run_id", "content_type", "truncated", F.size("pieces").alias("n"), F.posexplode("pieces").alias("chunk_idx", "p"))
    cards = cards.select(
        "run_id", "content_type", "chunk_idx", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.text").alias("chunk"), F.col("n").alias("n_chunks"), F.col("truncated").alias("truncated_chunks")
    )
    windows = chunking.window_chunks(ok.where("pieces is null").select("run_id", "content_type", "full_text"), "full_text", size, overlap, most, blank)
    return cards.unionByName(windows.select(cards.columns))


class Extraction:
    """The tables of a run. What the provider was asked is asked once: prepared texts, outcomes and proposals are written to the shared folder the first time that one of the tables needs them,
    and read from there by all. `release` removes them, after which the tables can't be read any more.

    prepared; chunks; outcomes (a row a chunk that was sent); proposals (all, with what became of them); kept; results (one row a run).
    """

    def __init__(self, docs: DataFrame, schema: DataFrame, provider: Provider, options: Options, **how):
        self.docs, self.schema, self.provider, self.options, self.how = docs, schema, provider, options, how
        self.written = Written(docs.sparkSession)
        self.stored: str | None = None

    @cached_property
    def fields(self) -> list[dict]:
        return [r.asDict() for r in self.schema.collect()]  # the caller's list of target fields

    @cached_property
    def wrong(self) -> str | None:
        """What is wrong with the call, as the error of every result: the task, then a capability, then the options."""
        task = self.how["task"]
        found = tasks.problem(task, self.fields, self.how["prepare"]) if task is not None else None
        if found:
            return f"invalid taskSpec: {found}"
        lacking = outcomes.missing_capability(getattr(self.provider, "capabilities", None), task is not None)
        if lacking:
            return f'provider {self.provider.name} does not support required capability "{lacking}"'
        return self.options.error()

    @cached_property
    def prepared(self) -> DataFrame:
        h = self.how
        table = self.written(prepared(self.docs, h["prep"], h["size"], h["most"], h["pdf_text"], h["image_text"], h["version"]))
        if h["store"] is not None and not self.wrong:
            try:
                h["store"](table.where("error is null").select(F.col("artifact.ref").alias("ref"), F.col("full_text").alias("text")))
            except Exception:  # a store's failure is a warning
                self.stored = STORAGE
        return table

    @cached_property
    def chunks(self) -> DataFrame:
        found = chunked(self.prepared, self.how["size"], self.how["overlap"], self.how["most"], self.how["blank"])
        return found.where(F.lit(False)) if self.wrong else found

    @cached_property
    def outcomes(self) -> DataFrame:
        o, task = self.options, self.how["task"]
        if task is not None:
            o = Options(**{**vars(o), "guidance": task.get("guidance"), "examples": task.get("examples") or []})
        got = dispatched(self.chunks, self.provider, self.fields, o, self.how["cancelled"])
        return self.written(got.withColumn("failure", F.when(~F.col("ok"), outcomes.failure(F.lit(self.provider.name), F.col("status"), F.col("code"), F.col("error"), F.col("retryable")))))

    @cached_property
    def proposals(self) -> DataFrame:
        raw = self.outcomes.where("ok").select("run_id", "chunk_idx", F.col("start").alias("visible_start"), F.col("end").alias("visible_end"), F.explode("proposals").alias("p")).select(
            "run_id", (F.col("chunk_idx").cast("bigint") * 2**32 + F.col("p.item")).alias("seq"), "chunk_idx", "p.is_object", "p.field_path", "p.value_json", "p.value_canon", "p.confidence", "p.excerpt",
            "p.extractor", "p.occurrence_hint", "visible_start", "visible_end",
        )
        return self.written(grounding.normalized(raw, self.prepared, self.schema, len(self.fields)))

    @cached_property
    def kept(self) -> DataFrame:
        """The deduplicated proposals; none of a run whose calls all failed."""
        return grounding.deduplicated(self.proposals.where("drop_reason is null"))

    @cached_property
    def results(self) -> DataFrame:
        return _results(self)

    def release(self) -> None:
        self.written.release()


def extract(
    docs: DataFrame, schema: DataFrame, provider: Provider, options: Options | None = None, prep: str | None = None,
    size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, most: int | None = chunking.MOST, *, task: dict | None = None, pdf_text: Reader | None = None, image_text: Reader | None = None,
    store: Callable[[DataFrame], None] | None = None, cancelled: Callable[[], bool] = lambda: False, version: str = artifacts.PREPARATION_VERSION, prepare: Callable[[str, str], str] = lambda content, kind: content,
    blank: bool = False,
) -> Extraction:
    """The run; nothing happens until one of its tables is asked for. Whatever is wrong with the call gives results with an error and no calls.

    `task`: a specification of `operators.tasks`, whose guidance and examples go to the provider. `pdf_text`, `image_text`: extractors of bytes. `store` is handed (ref, text) of the prepared
    texts. `cancelled` is asked before every wave of calls. `blank`: a text without characters is asked about too, in one call; else it gets a result without one.
    """
    return Extraction(
        docs, schema, provider, options or Options(), prep=prep, size=size, overlap=overlap, most=most, task=task, pdf_text=pdf_text, image_text=image_text, store=store, cancelled=cancelled,
        version=version, prepare=prepare, blank=blank,
    )


def _stop_text(o: Options):
    c = F.col
    reached = (
        F.when(c("stop_reason") == "max-provider-calls", F.lit(f"maxProviderCalls ({o.max_calls}) reached"))
        .when(c("stop_reason") == "max-total-tokens", F.concat(F.lit(f"maxTotalTokens ({o.max_tokens}) reached ("), c("total_tokens_used").cast("string"), F.lit(" tokens used)")))
        .otherwise(c("stop_reason"))
    )
    return F.concat(F.lit("stopped after "), c("provider_calls").cast("string"), F.lit(" provider call(s): "), reached, F.lit("; "), c("remaining").cast("string"), F.lit(" chunk(s) not processed"))


def _results(e: Extraction) -> DataFrame:
    pre, o, wrong, task, c = e.prepared, e.options, e.wrong, e.how["task"], F.col
    none, got = F.array().cast("array<string>"), e.outcomes
    sent = got.where("chunk_idx is not null")
    calls = got.groupBy("run_id").agg(
        F.max("provider_calls").alias("provider_calls"), F.max("tokens_used").alias("total_tokens_used"), F.max("stop_reason").alias("stop_reason"), F.max("remaining").alias("remaining"),
        F.sum(c("ok").cast("int")).alias("succeeded"), F.count("chunk_idx").alias("sent"), F.min_by("error", F.struct(c("error").isNull(), "chunk_idx")).alias("first_error"),
        F.max_by("response", F.struct("ok", "chunk_idx")).alias("last_response"), F.max_by("model", F.struct("ok", "chunk_idx")).alias("model"), F.max_by("tokens", F.struct("ok", "chunk_idx")).alias("raw_tokens"),
        F.array_sort(F.collect_list(F.when(~c("ok"), F.struct("chunk_idx", "failure")))).alias("failures"),
    )
    # warnings by chunk: what the provider said, then what became of its proposals
    failed_call = F.concat(F.lit("chunk "), (c("chunk_idx") + 1).cast("string"), F.lit("/"), c("n_chunks").cast("string"), F.lit(" provider call failed: "), F.coalesce("error", F.lit("")))
    said = sent.select("run_id", "chunk_idx", F.lit(0).alias("stage"), F.posexplode(F.when(c("ok"), c("warnings")).otherwise(F.array(failed_call))).alias("n", "w"))
    said = said.select("run_id", "chunk_idx", "stage", c("n").cast("bigint").alias("n"), "w")
    unlisted = sent.where("no_list").select("run_id", "chunk_idx", F.lit(1).alias("stage"), F.lit(-1).cast("bigint").alias("n"), F.lit("provider returned no proposals array").alias("w"))
    gates = e.proposals.where("warning is not null").select("run_id", "chunk_idx", F.lit(1).alias("stage"), c("seq").alias("n"), c("warning").alias("w"))
    ordered = said.unionByName(unlisted).unionByName(gates).groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "stage", "n", "w"))), lambda x: x["w"]).alias("chunk_warnings")
    )
    number = e.kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_proposals"), F.sum("duplicates").alias("n_duplicates"))
    cut = e.chunks.groupBy("run_id").agg(F.max("n_chunks").alias("n_chunks"), F.max("truncated_chunks").alias("truncated_chunks"), F.count(F.lit(1)).alias("n_kept"))
    r = pre.drop("full_text").join(cut, "run_id", "left").join(calls, "run_id", "left").join(ordered, "run_id", "left").join(number, "run_id", "left")
    failed = F.coalesce((c("sent") > 0) & (c("succeeded") == 0), F.lit(False))
    error = F.lit(wrong) if wrong else F.coalesce(c("error"), F.when(failed, c("first_error")))
    dup, cutoff = F.coalesce("n_duplicates", F.lit(0)), F.coalesce("truncated_chunks", F.lit(0))
    s = lambda n: F.when(n == 1, "").otherwise("s")
    end = F.array_compact(
        F.array(
            F.when(dup > 0, F.concat(F.lit("dropped "), dup.cast("string"), F.lit(" duplicate proposal"), s(dup), F.lit(" (same field + value + source span)"))),
            F.when(c("n_kept") > 1, F.concat(F.lit("chunked into "), c("n_kept").cast("string"), F.lit(" chunks by "), F.when(c("pieces").isNotNull(), F.concat(F.lit("repeated-card structure ("), c("card_count").cast("string"), F.lit(" cards detected)"))).otherwise("character window"))),
            F.when(cutoff > 0, F.concat(F.lit("dropped "), cutoff.cast("string"), F.lit(" chunk"), s(cutoff), F.lit(" beyond maxChunks; content truncated"))),
        )
    )
    stop = F.when(c("stop_reason").isNotNull(), F.array(_stop_text(o))).otherwise(none)
    stored = F.array(F.lit(e.stored)) if e.stored else none
    warnings = F.concat(c("warnings"), stored, stop, F.coalesce("chunk_warnings", none), end)
    reason = F.coalesce(c("stop_reason"), F.when((cutoff > 0) & ~failed, "max-chunks"))
    over = F.when(c("total_tokens_used") > F.lit(o.max_tokens), c("total_tokens_used") - F.lit(o.max_tokens)).cast("bigint") if o.max_tokens is not None and not wrong else F.lit(None).cast("bigint")
    listed = F.transform(F.array_compact(c("failures")), lambda x: x["failure"])
    whole = ~failed if not wrong else F.lit(False)
    digest = F.when(whole & c("error").isNull(), F.lit(task["digest"])) if task is not None else F.lit(None).cast("string")
    examples = F.when(whole & c("error").isNull(), F.array(*[F.lit(x["digest"]) for x in task.get("examples") or []]).cast("array<string>")) if task is not None else F.lit(None).cast("array<string>")
    valid = F.lit(not wrong) & c("error").isNull()
    return r.select(
        "run_id", "source_ref", "snapshot_ref", F.lit(e.provider.name).alias("provider"), F.when(whole, c("model")).alias("model"), error.alias("error"), F.when(error.isNotNull(), none).otherwise(warnings).alias("warnings"),
        F.coalesce("provider_calls", F.lit(0)).alias("provider_calls"), F.coalesce("total_tokens_used", F.lit(0)).alias("total_tokens_used"), F.when(error.isNull(), F.coalesce("n_proposals", F.lit(0))).otherwise(0).alias("n_proposals"),
        F.when(
            reason.isNotNull(),
            F.struct(
                reason.alias("reason"), F.coalesce("sent", F.lit(0)).alias("completed"), (F.coalesce("remaining", F.lit(0)) + F.when(~failed, cutoff).otherwise(0)).alias("remaining"),
                F.when(c("stop_reason").isNotNull(), over).alias("token_overshoot"),
            ),
        ).alias("partial"),
        F.when(F.size(listed) > 0, listed).alias("provider_failures"), digest.alias("task_digest"), examples.alias("example_digests"), F.when(valid, c("artifact")).alias("artifact"),
        F.when(valid, c("embedded")).alias("embedded"), F.when(valid, c("page_offsets")).alias("pdf_page_offsets"), F.when(valid, c("layout")).alias("pdf_layout"), F.when(valid & c("ocr_derived"), True).alias("ocr_derived"),
        F.when(whole, c("last_response")).alias("last_response"), F.when(whole, c("raw_tokens")).alias("raw_tokens"),
    )


def from_snapshots(snapshots: DataFrame) -> DataFrame:
    """Documents of snapshots (with run_id and snapshot_ref), for `extract`: the reference is where the text comes from, and part of its artifact."""
    data = F.col("body_bytes") if "body_bytes" in snapshots.columns else F.lit(None).cast("binary")
    return snapshots.select("run_id", F.col("snapshot_ref").alias("source_ref"), "snapshot_ref", F.col("body").alias("content"), data.alias("content_bytes"), "content_type")
