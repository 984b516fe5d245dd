"""Messages of a log (VARIANT) as blocks, file operations and usage figures.

A message that lacks a part, or holds something else where text is expected, loses that part and never fails a job.
Functions on arguments take the message's own text as `raw`, where it is at hand: it keeps their order and length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, nonblank_lines, once, sanitize, script_tokens
from . import arguments as A

#: Keys that hold a path, in the order they are tried.
PATH_KEYS = ("path", "file_path", "filePath", "file")
URI = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
NO_CONTENT = "(no file content found in tool call arguments)"
IMAGE_CHARS = 4800
BLOCK = {"kind": "string", "text": "string", "name": "string", "args": "variant", "command": "string", "output": "string", "exit_code": "int"}


def text_at(value: Column, path: str) -> Column:
    """The string at a path; null where there is none or where it is no string."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def parts(message: Column, *kinds: str) -> Column:
    """The parts of a message's content of the given types; empty where the content is no list."""
    listed = F.coalesce(F.try_variant_get(message, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(listed, lambda p: F.coalesce(text_at(p, "$.type").isin(*kinds), F.lit(False)))


def string_content(message: Column) -> Column:
    """The content where it is a string. A list is told from it first: the schema of a long one takes longest to make."""
    return F.when(F.try_variant_get(message, "$.content", "array<variant>").isNull(), text_at(message, "$.content"))


def content_text(message: Column) -> Column:
    """Text parts joined by LF, or the content itself where it is a string."""
    listed = F.array_join(F.transform(parts(message, "text"), lambda p: F.coalesce(text_at(p, "$.text"), F.lit(""))), "\n")
    return F.coalesce(string_content(message), listed)


def thinking_of(part: Column) -> Column:
    return F.coalesce(text_at(part, "$.text"), text_at(part, "$.thinking"), F.lit(""))


def file_path(args: Column) -> Column:
    """The first value under a path key that is a path of the file system, not a URI."""
    values = [text_at(args, f"$.{k}") for k in PATH_KEYS]
    return F.coalesce(*[F.when((v != "") & ~v.rlike(URI), v) for v in values])


def _edits(args: Column) -> Column:
    return F.try_variant_get(args, "$.edits", "array<variant>")


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def content_bearing(args: Column) -> Column:
    """Whether a call names a path and carries content, edits (all of them objects), or old or new text without edits."""
    named = F.coalesce(*[text_at(args, f"$.{k}") for k in PATH_KEYS]).isNotNull()
    filled = lambda k: F.coalesce(text_at(args, f"$.{k}") != "", F.lit(False))
    edits = F.coalesce((F.size(_edits(args)) > 0) & F.forall(_edits(args), _is_object), F.lit(False))
    alone = F.try_variant_get(args, "$.edits", "variant").isNull()
    return named & (filled("content") | edits | ((filled("oldText") | filled("newText")) & alone))


def call_text(args: Column) -> Column:
    """Content, then the old and new text of edits or of the call itself, each ended by LF."""
    ended = lambda v, k: F.coalesce(F.concat(text_at(v, f"$.{k}"), F.lit("\n")), F.lit(""))
    listed = F.array_join(F.transform(_edits(args), lambda e: F.concat(ended(e, "oldText"), ended(e, "newText"))), "")
    return F.concat(ended(args, "content"), F.coalesce(listed, F.concat(ended(args, "oldText"), ended(args, "newText"))))


def call_body(args: Column) -> Column:
    """What a call wrote, as it is shown: its content, else its edits one by one, else old and new text."""
    or_blank = lambda v, k: F.coalesce(text_at(v, f"$.{k}"), F.lit(""))
    shown = lambda e, i: F.concat(F.lit("--- edit "), (i + 1).cast("string"), F.lit(" ---\n"), or_blank(e, "oldText"), F.lit("\n--- becomes ---\n"), or_blank(e, "newText"))
    both = F.when((or_blank(args, "oldText") != "") & (or_blank(args, "newText") != ""), F.concat(F.lit("--- old ---\n"), or_blank(args, "oldText"), F.lit("\n--- new ---\n"), or_blank(args, "newText")))
    content = F.when(or_blank(args, "content") != "", or_blank(args, "content"))
    return F.coalesce(content, F.array_join(F.transform(F.filter(_edits(args), _is_object), shown), "\n\n"), both, F.lit(NO_CONTENT))


def _block(kind: str, **values: Column) -> Column:
    fields = {"kind": F.lit(kind)} | values
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in BLOCK.items()])


def as_blocks(messages: DataFrame) -> DataFrame:
    """Blocks of messages (session_id, seq, message): session_id, source (seq), blk (place in the session), kind, text,
    name, path, command, args, output, exit_code. Roles without a branch give none; a user message gives one at least.
    """
    m, role, clean, whole = (F.col(c) for c in ("message", "role", "clean", "whole"))
    read = messages.select("session_id", F.col("seq").alias("source"), "message", text_at(m, "$.role").alias("role"), string_content(m).alias("whole"), sanitize(content_text(m)).alias("clean"))
    images = F.transform(parts(m, "image"), lambda p: _block("user", text=F.concat(F.lit("[image: "), F.coalesce(text_at(p, "$.mimeType"), F.lit("undefined")), F.lit("]"))))
    empty = F.slice(F.array(_block("user", text=F.lit(""))), 1, 0)
    one = lambda when, block: F.when(when, F.array(block)).otherwise(empty)
    user = F.concat(one((clean != "") | (F.size(images) == 0), _block("user", text=clean)), images)
    said = lambda p: F.coalesce(text_at(p, "$.text"), F.lit(""))
    part = lambda p: (
        F.when(text_at(p, "$.type") == "text", _block("assistant", text=sanitize(said(p))))
        .when(text_at(p, "$.type") == "thinking", _block("thinking", text=sanitize(thinking_of(p))))
        .otherwise(_block("tool_call", name=text_at(p, "$.name"), args=F.try_variant_get(p, "$.arguments", "variant"), command=sanitize(text_at(p, "$.arguments.command"))))
    )
    spoken = F.filter(F.transform(parts(m, "text", "thinking", "toolCall"), part), lambda b: (b["kind"] != "thinking") | (b["text"] != ""))
    assistant = F.when(whole.isNotNull(), one(whole != "", _block("assistant", text=clean))).otherwise(spoken)
    shell = _block("bash", command=sanitize(F.coalesce(text_at(m, "$.command"), F.lit(""))), output=sanitize(F.coalesce(text_at(m, "$.output"), F.lit(""))), exit_code=F.try_variant_get(m, "$.exitCode", "int"))
    found = F.when(role == "user", user).when(role == "assistant", assistant).when(role == "bashExecution", F.array(shell))
    found = found.when(role == "toolResult", F.array(_block("tool_result", name=text_at(m, "$.toolName"), text=clean))).when(role == "custom", one(clean != "", _block("custom", text=clean)))
    # With the outer form no condition makes the blocks once more.
    rows = read.select("session_id", "source", F.posexplode_outer(found).alias("pos", "b")).where("b is not null")
    blk = (F.row_number().over(Window.partitionBy("session_id").orderBy("source", "pos")) - 1).cast("long")
    return rows.select("session_id", "source", blk.alias("blk"), "b.kind", "b.text", "b.name", file_path(F.col("b.args")).alias("path"), "b.command", "b.args", "b.output", "b.exit_code")


def file_operations(blocks: DataFrame) -> DataFrame:
    """Calls that carry file content: session_id, source, blk, name, path, n_lines (not blank), searched, body (shown)."""
    calls = blocks.where("kind = 'tool_call' and path is not null").where(content_bearing(F.col("args"))).where(F.coalesce(F.lower("name"), F.lit("")) != "bashexecution")
    text = call_text(F.col("args"))
    return calls.select(
        "session_id", "source", "blk", F.coalesce("name", F.lit("")).alias("name"), "path", F.size(nonblank_lines(text)).alias("n_lines"),
        F.concat_ws("\n", "path", text).alias("searched"), call_body(F.col("args")).alias("body"),
    )


def content_parts(message: Column, raw: Column | None, *kinds: str) -> Column:
    """All parts of a message's content as p with their texts as w (arguments.field), or those of the given types.

    Of given types only calls are read by their texts: a message whose text names none, not even escaped, isn't parsed for them.
    """
    if kinds and raw is not None:
        raw = F.when(F.contains(raw, F.lit("toolCall")) | F.contains(raw, F.lit("\\u")), raw)
    listed = F.coalesce(F.try_variant_get(message, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    found = A.pairs(listed, raw)
    return F.filter(found, lambda x: F.coalesce(text_at(x["p"], "$.type").isin(*kinds), F.lit(False))) if kinds else found


def content_chars(message: Column, raw: Column | None = None) -> Column:
    """Estimated characters of a message's content: text, thinking, names and arguments of calls, a fixed number an image."""
    size = lambda c: F.char_length(F.coalesce(c, F.lit("")))
    each = F.transform(content_parts(message, raw, "text", "thinking", "toolCall", "image"), lambda x: (
        F.when(text_at(x["p"], "$.type") == "text", size(text_at(x["p"], "$.text"))).when(text_at(x["p"], "$.type") == "thinking", size(text_at(x["p"], "$.thinking")))
        .when(text_at(x["p"], "$.type") == "image", F.lit(IMAGE_CHARS)).otherwise(size(text_at(x["p"], "$.name")) + size(A.field(x, "arguments")))
    ))
    return size(string_content(message)) + F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _raw(messages: DataFrame) -> Column | None:
    return F.col("raw") if "raw" in messages.columns else None


def outputs(messages: DataFrame) -> DataFrame:
    """messages (session_id, seq, id, message) as output_projection takes them: session_id, seq, id, output, done, tokens."""
    m = F.col("message")
    role = F.coalesce(text_at(m, "$.role"), F.lit(""))
    shell = role == "bashExecution"
    hidden = F.coalesce(F.to_json(F.try_variant_get(m, "$.excludeFromContext", "variant")) == "true", F.lit(False))
    listed = F.array_join(F.transform(parts(m, "text"), lambda p: F.coalesce(text_at(p, "$.text"), F.lit(""))), "")
    text = F.when(shell, F.coalesce(text_at(m, "$.output"), F.lit(""))).otherwise(F.coalesce(text_at(m, "$.content"), listed))
    done = (role == "assistant") & ~F.coalesce(text_at(m, "$.stopReason").isin("error", "aborted"), F.lit(False))
    return messages.select("session_id", "seq", "id", ((role == "toolResult") | (shell & ~hidden)).alias("output"), done.alias("done"), script_tokens(text).alias("tokens"))


def usage(messages: DataFrame) -> DataFrame:
    """Per session: n, users, assistants, tool_calls, models, span_ms, input_chars, output_chars and the sums of usage."""
    m = F.col("message")
    role = F.coalesce(text_at(m, "$.role"), F.lit("unknown"))
    shell = F.char_length(F.coalesce(text_at(m, "$.command"), F.lit(""))) + 1 + F.char_length(F.coalesce(text_at(m, "$.output"), F.lit("")))
    number = lambda path: F.coalesce(F.try_variant_get(m, path, "long"), F.lit(0)).cast("long")
    rows = messages.select(
        "session_id", role.alias("role"), F.when(text_at(m, "$.model") != "", text_at(m, "$.model")).alias("model"), F.try_variant_get(m, "$.timestamp", "long").alias("ts"),
        F.when(role == "bashExecution", shell).otherwise(content_chars(m, _raw(messages))).alias("chars"), F.size(parts(m, "toolCall")).alias("calls"),
        *[number(f"$.usage.{k}").alias(k) for k in ("input", "output", "cacheRead", "cacheWrite")],
    )
    spoken = F.col("role") == "assistant"
    return rows.groupBy("session_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(spoken).alias("assistants"),
        F.sum(F.when(spoken, F.col("calls")).otherwise(0)).alias("tool_calls"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), (F.max("ts") - F.min("ts")).alias("span_ms"),
        F.sum(F.when(spoken, 0).otherwise(F.col("chars"))).alias("input_chars"), F.sum(F.when(spoken, F.col("chars")).otherwise(0)).alias("output_chars"),
        F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"), F.sum("cacheRead").alias("cache_read"), F.sum("cacheWrite").alias("cache_write"),
    )


def event_messages(events: DataFrame) -> DataFrame:
    """session_id, seq, raw, message: events seen as messages of a session, through JSON text (raw) as a log would hold them."""
    raw = F.expr(r"""CASE event_type
      WHEN 'signup' THEN concat('{"role":"user","content":[{"type":"text","text":"please fix the parser of step ', event_id, '"}', CASE WHEN event_id % 5 = 0 THEN ',{"type":"image","mimeType":"image/png"}' ELSE '' END, ']}')
      WHEN 'click' THEN concat('{"role":"assistant","model":"m', event_id % 3, '","timestamp":', event_id * 7, ',"usage":{"input":', event_id % 50, ',"output":', event_id % 7, ',"cacheRead":', event_id % 11, ',"cacheWrite":', event_id % 13, '},"content":[{"type":"thinking","thinking":"t', event_id, '"},{"type":"text","text":"Hmm, step ', event_id, ' is done"}]}')
      WHEN 'purchase' THEN concat('{"role":"assistant","content":[{"type":"toolCall","name":"edit","arguments":{"path":"/repo/src/m', event_id % 7, '/f', event_id % 40, '.py",',
        CASE WHEN event_id % 2 = 0 THEN '"oldText":"a\\n","newText":"b\\nc\\n"' ELSE '"edits":[{"oldText":"x","newText":"y"},{"newText":"z\\n\\nw"}]' END, '}}]}')
      WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN concat('{"role":"toolResult","toolName":"edit","content":[{"type":"text","text":"ok ', event_id, '"}]}')
        ELSE concat('{"role":"assistant","content":[{"type":"toolCall","name":"read","arguments":{"file_path":"/repo/src/m', event_id % 7, '/f', event_id % 40, '.py"}}]}') END
      ELSE concat('{"role":"bashExecution","command":"', element_at(array('npm test', 'git commit -m x', 'ls -la', 'make'), cast(event_id % 4 + 1 as int)), '","output":"line ', event_id, '","exitCode":', event_id % 2, '}') END""")
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return events.select(F.col("user_id").alias("session_id"), seq.alias("seq"), raw.alias("raw"), F.try_parse_json(raw).alias("message"))


# Messages as text: what a search reads, what a listing shows, and what they cost.

ARGS_MOST, LISTED_MOST, RESULT_MOST = 2000, 300, 200


def _joined(*values: Column, by: str = "\n") -> Column:
    """What is not empty."""
    return F.array_join(F.filter(F.array(*values), lambda x: x != ""), by)


def _or_empty(value: Column, path: str) -> Column:
    return F.coalesce(text_at(value, path), F.lit(""))


def thoughts(message: Column) -> Column:
    """Thinking of all parts that have any, else their text."""
    each = F.transform(parts(message, "thinking"), lambda p: F.coalesce(text_at(p, "$.thinking"), _or_empty(p, "$.text")))
    return F.array_join(F.filter(each, lambda x: x != ""), "\n")


def arguments_text(message: Column, without: tuple[str, ...] = (), raw: Column | None = None) -> Column:
    """All strings of the arguments of all calls but those of some tools, one level deep in lists, joined by LF, clipped together."""
    calls = F.filter(content_parts(message, raw, "toolCall"), lambda x: ~F.lower(_or_empty(x["p"], "$.name")).isin(list(without)) if without else F.lit(True))
    each = F.transform(F.transform(calls, lambda x: A.field(x, "arguments")), lambda args: F.array_join(A.strings(args), "\n"))
    return once(F.array_join(F.filter(each, lambda x: x != ""), "\n"), lambda text: clip(text, ARGS_MOST))


def mentioned_files(message: Column) -> Column:
    listed = F.coalesce(F.try_variant_get(message, "$.files", "array<variant>"), F.array().cast("array<variant>"))
    return F.array_join(F.transform(listed, lambda f: F.concat_ws("\n", _or_empty(f, "$.path"), _or_empty(f, "$.content"))), "\n")


def shape_text(message: Column, by: str = "\n") -> Column:
    """Text of the roles that keep it outside content; null for all others."""
    role = text_at(message, "$.role")
    two = lambda a, b: F.concat(_or_empty(message, a), F.lit(by), _or_empty(message, b))
    found = F.when(role == "bashExecution", two("$.command", "$.output")).when(role == "pythonExecution", two("$.code", "$.output"))
    return found.when(role.isin("branchSummary", "compactionSummary"), _or_empty(message, "$.summary")).when(role == "fileMention", mentioned_files(message))


def message_text(message: Column) -> Column:
    return F.coalesce(shape_text(message), content_text(message))


def search_document(message: Column, own_tool: str = "recall", raw: Column | None = None) -> Column:
    """What a search reads: text, thinking and arguments; of shell, python and file mentions their own; nothing of the calls
    and results of the tool that searches."""
    role = _or_empty(message, "$.role")
    said = _joined(content_text(message), thoughts(message), arguments_text(message, (own_tool,), raw))
    own = (role == "toolResult") & (F.lower(_or_empty(message, "$.toolName")) == own_tool)
    return F.when(role.isin("bashExecution", "pythonExecution", "fileMention"), shape_text(message, " ")).when(own, "").otherwise(said)


def argument_summary(part: Column) -> Column:
    """path, command or query of a call (of content_parts), else the names of its arguments in order."""
    args = F.try_variant_get(part["p"], "$.arguments", "variant")
    told = lambda k: F.concat(F.lit(f"{k}="), text_at(args, f"$.{k}"))
    return F.coalesce(F.concat(F.lit("path="), file_path(args)), told("command"), told("query"), F.array_join(A.names(A.field(part, "arguments")), ", "))


#: Roles that a listing names, whatever the message holds.
NAMED_ROLES = {"user": "user", "bashExecution": "bash", "pythonExecution": "python", "fileMention": "file_mention", "toolResult": "tool_result"}


def rendered_role(message: Column) -> Column:
    """The role of rendered() alone, without its summary."""
    role = _or_empty(message, "$.role")
    only_thought = (F.size(parts(message, "toolCall")) == 0) & (content_text(message) == "") & (thoughts(message) != "")
    found = reduce(lambda c, k: c.when(role == k, NAMED_ROLES[k]), list(NAMED_ROLES)[1:], F.when(role == "user", "user"))
    return found.when(only_thought, "thinking").otherwise(F.when(role != "", role).otherwise("assistant"))


def rendered(message: Column, full: bool = False, raw: Column | None = None) -> Column:
    """struct of role and summary, as a listing shows a message; full: unclipped, with thinking and arguments."""
    role = _or_empty(message, "$.role")
    cut = lambda x, most=LISTED_MOST: x if full else clip(x, most)
    text, thinking = cut(content_text(message)), thoughts(message)
    calls = F.array_join(F.transform(content_parts(message, raw, "toolCall"), lambda x: F.concat(_or_empty(x["p"], "$.name"), F.lit("("), argument_summary(x), F.lit(")"))), ", ")
    base = F.when(calls != "", F.concat(calls, F.lit("\n"), text)).otherwise(text)
    titled = lambda title, x: F.when(x != "", F.concat(F.lit(f"[{title}]\n"), x)).otherwise("")
    said = _joined(titled("thinking", thinking), base, titled("tool args", arguments_text(message, raw=raw)), by="\n\n") if full else base
    ran = lambda mark, k: cut(F.concat(F.lit(mark), _or_empty(message, f"$.{k}"), F.lit("\n"), _or_empty(message, "$.output")))
    only_thought = (text == "") & (calls == "") & (thinking != "")
    shown = lambda name, x: F.struct(F.lit(name).alias("role") if isinstance(name, str) else name.alias("role"), x.alias("summary"))
    kinds = {
        "user": text, "bashExecution": ran("$ ", "command"), "pythonExecution": ran(">>> ", "code"), "fileMention": cut(mentioned_files(message)),
        "toolResult": F.concat(F.lit("["), _or_empty(message, "$.toolName"), F.lit("] "), cut(content_text(message), RESULT_MOST)),
    }
    found = F.when(only_thought & ~role.isin(list(kinds)), shown("thinking", cut(thinking)))
    for kind, x in kinds.items():
        found = found.when(role == kind, shown(NAMED_ROLES[kind], x))
    return found.otherwise(shown(F.when(role != "", role).otherwise("assistant"), said))


def preview(message: Column, most: int = LISTED_MOST) -> Column:
    """The first characters of a message's content, other parts by their names."""
    listed = F.coalesce(F.try_variant_get(message, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda p: F.coalesce(text_at(p, "$.type"), F.lit("unknown"))
    named = lambda p: F.when(kind(p) == "toolCall", F.concat(F.lit("toolCall:"), F.coalesce(text_at(p, "$.name"), F.lit("undefined")))).when(kind(p) == "image", F.concat(F.lit("image:"), F.coalesce(text_at(p, "$.mimeType"), F.lit("undefined")))).otherwise(kind(p))
    each = F.transform(listed, lambda p: F.when(kind(p) == "text", _or_empty(p, "$.text")).otherwise(F.concat(F.lit("["), named(p), F.lit("]"))))
    return F.substring(F.coalesce(text_at(message, "$.content"), F.array_join(each, "\n")), 1, most)


def message_tokens(message: Column, raw: Column | None = None) -> Column:
    """Estimated tokens of a message, by script, part by part."""
    kind = lambda x: _or_empty(x["p"], "$.type")
    told = lambda x, name: F.coalesce(A.field(x, name), F.lit(""))
    args = lambda x: F.coalesce(*[F.nullif(told(x, k), F.lit("")) for k in ("arguments", "input")], F.lit(""))
    each = F.transform(content_parts(message, raw), lambda x: (
        F.when(kind(x) == "thinking", script_tokens(_or_empty(x["p"], "$.thinking"))).when(kind(x) == "toolCall", script_tokens(F.concat(_or_empty(x["p"], "$.name"), args(x))))
        .when(kind(x) == "toolResult", script_tokens(told(x, "content"))).when(kind(x) == "image", F.lit(IMAGE_CHARS // 4).cast("long")).otherwise(script_tokens(_or_empty(x["p"], "$.text")))
    ))
    whole = F.coalesce(shape_text(message), string_content(message))
    return F.when(whole.isNotNull(), script_tokens(whole)).otherwise(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x))


def with_marker(message: Column, marker: Column) -> Column:
    """A message's content (array of VARIANT) with a marker in place of its first text part; later text parts go."""
    listed = F.try_variant_get(message, "$.content", "array<variant>")
    is_text = lambda p: _or_empty(p, "$.type") == "text"
    first = F.array_position(F.transform(listed, is_text), F.lit(True)) - 1
    kept = F.filter(listed, lambda p, i: ~is_text(p) | (i == first))
    put = lambda p: F.to_variant_object(F.map_concat(F.map_filter(F.try_variant_get(p, "$", "map<string,variant>"), lambda k, _: k != "text"), F.map_from_arrays(F.array(F.lit("text")), F.array(marker.cast("variant")))))
    return F.transform(kept, lambda p: F.when(is_text(p), put(p)).otherwise(p))


def without_markers(messages: DataFrame, hidden: list[str]) -> DataFrame:
    """messages without custom ones of hidden types, such as a host's own continuation messages."""
    m = F.col("message")
    return messages.where(~((_or_empty(m, "$.role") == "custom") & _or_empty(m, "$.customType").isin(hidden)))


def valid_details(details: Column, compactor: str) -> Column:
    """Whether the details of a summary are a whole segment of an append chain."""
    text = lambda path: _or_empty(details, path) != ""
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(details, path, "variant")), F.lit(""))
    whole = lambda path, least: (kind(path) == "BIGINT") & (F.coalesce(F.try_variant_get(details, path, "long"), F.lit(-1)) >= least)
    amount = lambda path: (kind(path).isin("BIGINT", "DOUBLE") | kind(path).startswith("DECIMAL")) & (F.coalesce(F.try_variant_get(details, path, "double"), F.lit(-1.0)) >= 0)
    maybe = lambda path, name: kind(path).isin("", name)
    listed = lambda path: F.coalesce(F.try_variant_get(details, path, "array<variant>"), F.lit(None))
    projection = "$.retainedToolOutputProjection"
    omitted = F.forall(listed(f"{projection}.omissions"), lambda o: (_or_empty(o, "$.entryId") != "") & (_or_empty(o, "$.marker") != ""))
    projected = (kind(projection) == "") | ((F.try_variant_get(details, f"{projection}.version", "long") == 1) & amount(f"{projection}.retainedTokens") & amount(f"{projection}.omittedTokens") & whole(f"{projection}.pendingCount", 0) & omitted)
    rules = [
        text_at(details, "$.compactor") == compactor, F.try_variant_get(details, "$.version", "long") == 3, text_at(details, "$.summaryMode") == "append", kind("$.chainStart") == "BOOLEAN", text("$.trailingSummary"),
        F.forall(listed("$.sections"), lambda x: (F.schema_of_variant(x) == "STRING") & (F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")) != "")), whole("$.sourceMessageCount", 0), kind("$.previousSummaryUsed") == "BOOLEAN",
        whole("$.segment.sequence", 1), text("$.segment.summary"), amount("$.segment.tokensBefore"), text("$.segment.coverage.firstCoveredEntryId"), text("$.segment.coverage.lastCoveredEntryId"), kind("$.segment.coverage.firstKeptEntryId") == "STRING",
        whole("$.segment.coverage.sourceMessageCount", 1), maybe("$.segment.coverage.includesLegacySummary", "BOOLEAN"), maybe("$.segment.coverage.rebasedFromCompactionId", "STRING"), projected,
    ]
    ok = F.lit(True)
    for rule in rules:
        ok = ok & F.coalesce(rule, F.lit(False))
    return ok
