"""Chat templates as Columns over message arrays: marks around each role's content, a head, a generation prompt.

``TEMPLATES`` holds shapes; heads, default system prompts and closing lines that name a product or a task are parameters,
so templates that differ in these alone share a shape.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after_last, col

#: Fixed wording (DeepSeek-AI 2025, arXiv:2501.12948).
REASONING_HEAD = (
    "A conversation between User and Assistant. The user asks a question, and the Assistant solves it. "
    "The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. "
    "The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, "
    "i.e., <think> reasoning process here </think> <answer> answer here </answer>.\n\n"
)
NO_FUNCTIONS = " You do not currently have access to any functions. <functions></functions>"


@dataclass(frozen=True)
class Template:
    """``before`` and ``after`` a content by role ("*" for all others; roles without an entry are left out).

    ``{Role}`` stands for the capitalised role and ``{eos}`` for the end sign. ``last_after`` replaces ``after`` on the
    last message. ``thinking``: keep it, drop all of it, or drop it from all but the last answer.
    """

    before: dict[str, str]
    after: dict[str, str] = field(default_factory=dict)
    last_after: dict[str, str] = field(default_factory=dict)
    between: str = ""
    head: str = ""
    system: str | None = None
    generation: str = ""
    thinking: str = "keep"
    end: str = ""


_BARS = {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}
_IM = {r: f"<|im_start|>{r}\n" for r in ("system", "user", "assistant", "environment")}
_IM_END = {r: "<|im_end|>\n" for r in ("user", "assistant", "environment")} | {"system": NO_FUNCTIONS + "<|im_end|>\n"}

TEMPLATES: dict[str, Template] = {
    "concat_space": Template({"*": ""}, between=" ", end="{eos}"),
    "concat_line": Template({"*": ""}, between="\n", end="{eos}"),
    "contents": Template({"*": ""}, {"*": "\n"}, between="\n\n"),
    "named": Template({"*": "{Role}: "}, between="\n\n", end="{eos}"),
    "assistant_only": Template({"assistant": ""}),
    "bars_closed": Template(_BARS, {r: "{eos}\n" for r in _BARS}, generation="<|assistant|>\n"),
    "bars": Template(_BARS, {"system": "\n", "user": "\n", "assistant": "{eos}\n"}, {"assistant": "{eos}"}, generation="<|assistant|>\n"),
    "bars_thinking": Template(_BARS, {"system": "\n", "user": "\n", "assistant": "{eos}\n"}, {"assistant": "{eos}"}, generation="<|assistant|>\n<think>"),
    "bars_reasoning": Template(_BARS, {"system": "\n", "user": "\n", "assistant": "{eos}\n"}, {"assistant": "{eos}"}, head=REASONING_HEAD, generation="<|assistant|>\n<think>", thinking="drop"),
    "im": Template(_IM, _IM_END, {"assistant": "{eos}"}, system="You are a helpful AI assistant.", generation="<|im_start|>assistant\n"),
    "im_thinking": Template(_IM, _IM_END, {"assistant": "{eos}"}, system="You are a helpful AI assistant.", generation="<|im_start|>assistant\n<think>"),
    "im_thinking_last": Template(_IM, _IM_END, {"assistant": "{eos}"}, system="You are a helpful AI assistant.", generation="<|im_start|>assistant\n<think>", thinking="last"),
    "reasoning": Template({"*": "{Role}: "}, {"*": "\n"}, between="\n\n", head=REASONING_HEAD, generation="Assistant:"),
    "reasoning_open": Template({"*": "{Role}: "}, {"*": "\n"}, between="\n\n", head=REASONING_HEAD, generation="Assistant: <think>"),
    "reasoning_boxed": Template(
        {"*": "{Role}: You must put your answer inside <answer> </answer> tags, i.e., <answer> answer here </answer>. And your final answer will be extracted automatically by the \\boxed{} tag. This is the problem: "},
        {"*": "\n"}, between="\n\n", head=REASONING_HEAD, generation="Assistant: <think>",
    ),
    "sections_ja": Template({"user": "\n\n### 指示:\n", "assistant": "\n\n### 応答:\n"}, system=None, generation="\n\n### 応答:\n"),
}


def render(messages, template: str | Template, eos: str = "</s>", prompt: bool = False, head: str | None = None, system: str | None = None, generation: str | None = None, tools: bool = False) -> Column:
    """The text of a message array; ``prompt`` adds the generation prompt and no end sign.

    ``head``, ``system`` and ``generation`` replace the template's own; the default system message stands where there is none.
    ``tools``: messages have the fields functions and function_calls too, text or null, which follow the content.
    """
    t = TEMPLATES[template] if isinstance(template, str) else template
    t = replace(t, head=t.head if head is None else head, system=t.system if system is None else system, generation=t.generation if generation is None else generation)
    m = col(messages)
    n = F.size(m)

    def mark(table: dict[str, str], role: Column) -> Column:
        out = F.lit(table["*"]) if "*" in table else F.lit("")
        for r, text in table.items():
            if r != "*":
                out = F.when(role == r, F.lit(text)).otherwise(out)
        return F.replace(F.replace(out, F.lit("{eos}"), F.lit(eos)), F.lit("{Role}"), F.initcap(role))

    def content(x: Column, i: Column) -> Column:
        c = F.coalesce(x["content"], F.lit(""))
        if t.thinking == "keep":
            return c
        bare = F.regexp_replace(after_last(c, "</think>"), r"^\n+", "") if t.thinking == "last" else after_last(c, "</think>")
        drop = (x["role"] == "assistant") & c.contains("</think>")
        return F.when(drop & ((i < n - 1) & c.contains("<think>") if t.thinking == "last" else F.lit(True)), bare).otherwise(c)

    def called(x: Column) -> Column:
        known = F.concat(F.when(x["role"] == "system", " ").otherwise("\n"), F.lit("<functions>"), x["functions"], F.lit("</functions>"))
        calls = F.concat(F.lit("<function_calls>"), x["function_calls"], F.lit("</function_calls>"))
        return F.coalesce(F.when(x["role"].isin("system", "user"), known).when(x["role"] == "assistant", calls), F.lit(""))

    def one(x: Column, i: Column) -> Column:
        closing = F.when(i == n - 1, mark({**t.after, **t.last_after}, x["role"])).otherwise(mark(t.after, x["role"]))
        known = F.lit(True) if "*" in t.before else x["role"].isin(*t.before)
        if tools:
            closing = F.when((x["role"] == "system") & x["functions"].isNotNull(), F.replace(closing, F.lit(NO_FUNCTIONS), F.lit(""))).otherwise(closing)
        return F.when(known, F.concat(mark(t.before, x["role"]), content(x, i), called(x) if tools else F.lit(""), closing))

    body = F.array_join(F.transform(m, one), t.between)
    parts = [F.lit(t.head)]
    if t.system:
        opening = t.before.get("system", "") + t.system + t.after.get("system", "")
        parts.append(F.when(F.exists(m, lambda x: x["role"] == "system"), "").otherwise(opening.replace("{eos}", eos)))
    parts.append(body)
    parts.append(F.lit(t.generation if prompt else t.end.replace("{eos}", eos)))
    return F.concat(*parts)
