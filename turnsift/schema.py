"""Kinds, points, widths and table schemas.  Missing is never null in the tables: it is
an empty string, 0 or 0.0 (an undated turn has ts 0.0)."""

from pyspark.sql import types as T

# Names and points of the kinds, and their labels in output.
KINDS = ("user_request", "error", "assistant_text", "tool_input", "tool_output", "thinking", "meta")
KIND_POINTS = {"user_request": 5, "error": 4, "assistant_text": 3, "tool_input": 2, "tool_output": 1, "thinking": 1, "meta": 0}
KIND_LABELS = {"user_request": "you asked", "error": "ERROR", "assistant_text": "assistant", "tool_input": "tool call", "tool_output": "tool out", "thinking": "thinking", "meta": "meta"}
SOURCES = ("claude_code", "codex", "claude_prompts")
TERM_POINTS, PHRASE_POINTS, PHRASE_WINDOW = 2, 3, 60
RECENCY_BANDS = ((7, 3), (30, 2), (180, 1))
MOST_EXTRA = 5
EXCERPT_WIDTH, CONTEXT_WIDTH = 260, 130
MAX_TEXT = 20_000
DEFAULT_LIMIT, DEFAULT_SCAN = 10, 4000
SCHEMA_VERSION = 4
# End of the fixed values.

TURNS = T.StructType(
    [
        T.StructField("turn_id", T.LongType()),
        T.StructField("session_key", T.LongType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("sidechain", T.BooleanType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("orig_len", T.IntegerType()),
        T.StructField("text_tok", T.StringType()),
        T.StructField("target_tok", T.StringType()),
    ]
)
SESSIONS = T.StructType(
    [
        T.StructField("session_key", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("first_ts", T.DoubleType()),
        T.StructField("last_ts", T.DoubleType()),
        T.StructField("turns", T.IntegerType()),
    ]
)
