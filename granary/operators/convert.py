"""Schema conversion: heterogeneous records to messages, preference pairs and verifiable prompts.

One declarative ``convert`` covers the single-turn corpora; each entry of SPECS names the columns or templates of the
turns. Conversations with other role names, transcripts, score pairs and verifiable answers have functions of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, col, let, replace_all, split_plain, strip

MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str | Column, content: Column) -> Column:
    return F.struct((role if isinstance(role, Column) else F.lit(role)).alias("role"), content.cast("string").alias("content"))


def turns(*parts: tuple[str, Column]) -> Column:
    return F.array(*[message(r, c) for r, c in parts])


def fill(template: str, **columns: Column | str) -> Column:
    """A template whose {name} are columns."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col(value).cast("string"), F.lit("")))
    return out


#: Fixed wording of the instruction template with input.
WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:"
)

#: Single-turn corpora: (role, column or template) in order; a role "system" is left out where its column is empty.
SPECS: dict[str, list[tuple[str, str]]] = {
    "instruction_template": [("user", WITH_INPUT), ("assistant", "{output}")],
    "instruction_output": [("user", "{instruction}"), ("assistant", "{output}")],
    "query_answer": [("user", "{query}"), ("assistant", "{answer}")],
    "query_response": [("user", "{query}"), ("assistant", "{response}")],
    "question_response": [("user", "{question}"), ("assistant", "{response}")],
    "question_response_system": [("system", "{system_prompt}"), ("user", "{question}"), ("assistant", "{response}")],
    "prompt_completion": [("user", "{prompt}"), ("assistant", "{completion}")],
    "inputs_targets": [("user", "{inputs}"), ("assistant", "{targets}")],
    "prompt_response": [("user", "{prompt}"), ("assistant", "{response}")],
    "problem_solution": [("user", "{problem}"), ("assistant", "{solution}")],
    "question_solution": [("user", "{question}"), ("assistant", "{generated_solution}")],
    "input_output": [("user", "{input}"), ("assistant", "{output}")],
}

#: Role names of other schemas.
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "chatgpt": "assistant", "bard": "assistant", "bing": "assistant", "assistant": "assistant", "system": "system"}


def convert(df: DataFrame, spec: str | list[tuple[str, str]], out: str = "messages") -> DataFrame:
    """``df`` with messages by a spec; {column} in a template stands for the column's text."""
    parts = []
    for role, template in SPECS[spec] if isinstance(spec, str) else spec:
        names = [c for c in df.columns if "{" + c + "}" in template]
        content = fill(template, **{c: F.col(f"`{c}`") for c in names}) if template != "{" + "".join(names[:1]) + "}" else F.col(f"`{names[0]}`")
        one = F.array(message(role, content))
        parts.append(F.when(blank(content), F.array().cast(MESSAGES)).otherwise(one) if role == "system" else one)
    return df.withColumn(out, F.concat(*parts))


def auto_convert(df: DataFrame) -> DataFrame:
    """Messages by the columns that are there, the first rule that fits; unchanged if there are messages already."""
    have = set(df.columns)
    rules = [
        ({"instruction", "output"}, lambda d: convert(d, "instruction_template" if "input" in have else "instruction_output")),
        ({"prompt", "completion"}, lambda d: convert(d, "prompt_completion")),
        ({"conversations"}, lambda d: d.withColumn("messages", from_turns("conversations"))),
        ({"question", "response"}, lambda d: convert(d, "question_response_system" if "system_prompt" in have else "question_response")),
        ({"query", "answer"}, lambda d: convert(d, "query_answer")),
        ({"query", "response"}, lambda d: convert(d, "query_response")),
        ({"chosen", "rejected", "reference_completion"}, lambda d: d.withColumn("messages", F.col("chosen"))),
    ]
    if "messages" in have:
        return df
    for need, rule in rules:
        if need <= have:
            return rule(df)
    raise ValueError(f"no rule fits the columns {sorted(have)}")


def from_turns(turns_: Column | str, roles: dict[str, str] | None = None, strict: bool = True, role_field: str = "from", content_field: str = "value") -> Column:
    """Messages of {from, value} turns; an unknown role raises, or is the assistant's if not ``strict``."""
    names = F.create_map(*[F.lit(x) for kv in (roles or ROLES).items() for x in kv])
    unknown = (lambda r: F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(r, F.lit("null")))).cast("string")) if strict else lambda r: F.lit("assistant")
    return F.transform(col(turns_), lambda t: message(F.coalesce(F.try_element_at(names, t[role_field]), unknown(t[role_field])), t[content_field]))


def alternating(strings: Column | str) -> Column:
    """Messages of strings that alternate between user and assistant; an odd last one is cut."""
    even = lambda a: F.slice(a, 1, F.size(a) - F.size(a) % 2)
    return F.transform(even(col(strings)), lambda s, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), s))


def assemble(turns_: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of long-form turns, in their order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns_.groupBy(key).agg(F.transform(ordered, lambda m: message(m["role"], m["content"])).alias("messages"))


def explode_turns(df: DataFrame, key: str = "conv_id", messages: str = "messages") -> DataFrame:
    """Long form: (key, turn, role, text)."""
    return df.select(key, F.posexplode(messages).alias("turn", "m")).select(key, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def as_list(value: Column | str, is_array: bool) -> Column:
    """An array of strings of a scalar or an array; nothing of null."""
    c = col(value)
    return F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")) if is_array else F.when(c.isNotNull(), F.array(c.cast("string"))).otherwise(F.array().cast("array<string>"))


def with_ground_truth(df: DataFrame, question: str, answer: str, dataset: str = "math") -> DataFrame:
    """Messages of the question alone, its answers as a list, and the verifier's name."""
    array = dict(df.dtypes)[answer].startswith("array")
    tagged = df if "dataset" in df.columns else df.withColumn("dataset", F.lit(dataset))
    return tagged.withColumn("messages", turns(("user", F.col(question)))).withColumn("ground_truth", as_list(answer, array)).withColumn("dataset", as_list("dataset", dict(tagged.dtypes)["dataset"].startswith("array")))


def flatten_prompt(messages: Column | str, joiner: str = "\n") -> Column:
    """``role: content`` lines."""
    return F.array_join(F.transform(col(messages), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), joiner)


def transcript(messages: Column | str, user: str = "User", assistant: str = "Assistant") -> Column:
    """``User: ...`` and ``Assistant: ...`` paragraphs; empty contents are skipped, other roles capitalised."""
    name = lambda r: F.when(r == "user", user).when(r == "assistant", assistant).otherwise(F.initcap(r))
    filled = F.filter(col(messages), lambda m: m["content"].isNotNull() & (m["content"] != ""))
    return F.array_join(F.transform(filled, lambda m: F.concat(name(m["role"]), F.lit(": "), strip(m["content"]))), "\n\n")


def with_system(messages: Column | str, prompt: str) -> Column:
    """A system prompt in front, in place of one that is there."""
    rest = F.filter(col(messages), lambda m, i: ~((i == 0) & (m["role"] == "system")))
    return F.concat(F.array(message("system", F.lit(prompt))), rest)


def without_last_answer(messages: Column | str) -> Column:
    """Without a last message of the assistant, if it is not the only one."""
    m = col(messages)
    return F.when((F.size(m) > 1) & (F.try_element_at(m, F.lit(-1))["role"] == "assistant"), F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)


def last_of(messages: Column | str, role: str = "assistant") -> Column:
    return F.try_element_at(F.filter(col(messages), lambda m: m["role"] == role), F.lit(-1))["content"]


def map_contents(messages: Column | str, f, role: str | None = None) -> Column:
    """Messages with their contents changed, of one role or all."""
    return F.transform(col(messages), lambda m: message(m["role"], F.when(m["role"] == role, f(m["content"])).otherwise(m["content"]) if role else f(m["content"])))


#: What special tokens become, in this order.
SPECIAL = [("<think>", "\n"), ("</think>", ""), ("<answer>", "\n\n"), ("</answer>", "")]


def plain_tokens(text: Column | str) -> Column:
    return strip(replace_all(text, SPECIAL))


def add_answer_tags(text: Column | str) -> Column:
    """What follows the thinking section within answer tags."""
    parts = split_plain(text, "</think>")
    return F.when(F.size(parts) == 2, F.concat(parts[0], F.lit("</think>\n<answer>"), strip(F.try_element_at(parts, F.lit(2))), F.lit("</answer>"))).otherwise(col(text))


def remove_answer_tags(text: Column | str) -> Column:
    return strip(replace_all(text, [("<answer>", ""), ("</answer>", "")]))


def substitute(messages: Column | str, values: dict[str, str]) -> Column:
    """Contents with {placeholders} filled."""
    return map_contents(messages, lambda c: replace_all(c, [("{" + k + "}", v) for k, v in values.items()]))


def parse_transcript(text: Column | str, user: str = "\n\nHuman: ", assistant: str = "\n\nAssistant: ") -> Column:
    """Messages of a transcript with marks before each turn, stripped."""
    parts = F.split(col(text), rf"(?=\Q{user}\E)|(?=\Q{assistant}\E)", -1)
    known = F.filter(parts, lambda p: F.startswith(p, F.lit(user)) | F.startswith(p, F.lit(assistant)))
    one = lambda p: F.when(F.startswith(p, F.lit(user)), message("user", strip(F.substr(p, F.lit(len(user) + 1))))).otherwise(message("assistant", strip(F.substr(p, F.lit(len(assistant) + 1)))))
    return F.transform(known, one)


def quoted_pairs(df: DataFrame, question: str, quotes: tuple[str, str], answers: tuple[str, str], scores: tuple[str, str], system: str) -> DataFrame:
    """Preference pairs of two scored answers with numbered quotes in the prompt; ties are dropped, margin is the difference."""
    def side(i: int) -> Column:
        cited = F.array_join(F.transform(F.col(quotes[i]), lambda q, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), q)), "\n\n")
        return turns(("system", F.lit(system)), ("user", F.concat_ws("\n\n", F.col(question), cited)), ("assistant", F.col(answers[i])))

    a, b = F.col(scores[0]), F.col(scores[1])
    return df.where(a != b).select("*", F.when(a > b, side(0)).otherwise(side(1)).alias("chosen"), F.when(a > b, side(1)).otherwise(side(0)).alias("rejected"), F.abs(a - b).alias("margin"))


def instruction_prompt(instruction: Column | str, given: Column | str, key: Column | str | None = None, with_input: list[tuple[str, float]] = (), without_input: list[tuple[str, float]] = (), seed: int = 1) -> Column:
    """The prompt of an instruction and its input, both stripped, parted and ended by an empty line; without a blank input.

    With templates, (text with {instruction} and {input}, weight), one is chosen by a stable hash of the key.
    """
    i, x = strip(col(instruction)), strip(F.coalesce(col(given).cast("string"), F.lit("")))

    def chosen(templates: list[tuple[str, float]], plain: Column) -> Column:
        if not templates:
            return plain
        total, upto, out = sum(w for _, w in templates), 0.0, None
        at = F.pmod(F.xxhash64(F.lit(seed), col(key)), F.lit(1 << 20)) / float(1 << 20)
        for text, weight in templates:
            upto += weight / total
            filled = F.replace(F.replace(F.lit(text), F.lit("{instruction}"), i), F.lit("{input}"), x)
            out = F.when(at < upto, filled) if out is None else out.when(at < upto, filled)
        return out.otherwise(filled)

    end = F.lit("\n\n")
    return F.when(x != "", chosen(with_input, F.concat(i, end, x, end))).otherwise(chosen(without_input, F.concat(i, end)))


def shown_examples(instruction: Column | str, examples: Column | str, given: Column | str) -> Column:
    """An instruction, worked examples (an array of input and output), and the input to answer."""
    one = lambda e: F.concat(F.lit("Input:\n"), strip(e["input"]), F.lit("\nOutput:\n"), strip(e["output"]), F.lit("\n\n"))
    return F.concat(strip(col(instruction)), F.lit("\n\n"), F.array_join(F.transform(col(examples), one), ""), F.lit("Input:\n"), strip(col(given)), F.lit("\nOutput:\n"))


def open_prompt(prompt: Column | str) -> Column:
    """A line feed after a prompt that ends neither with one nor with a colon."""
    p = col(prompt)
    return F.when(F.endswith(p, F.lit("\n")) | F.endswith(F.regexp_replace(p, r"(?U)\s+$", ""), F.lit(":")), p).otherwise(F.concat(p, F.lit("\n")))


def marked_rounds(text: Column | str, user: str = "[|Human|]", assistant: str = "[|AI|]") -> Column:
    """Messages of rounds behind a mark of the user's, each with one of the assistant's; what stands before the first one goes."""
    parts = split_plain(text, user)
    rounds = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda r: F.contains(r, F.lit(assistant)))
    both = lambda r: split_plain(r, assistant)
    return F.flatten(F.transform(rounds, lambda r: turns(("user", strip(both(r)[0])), ("assistant", strip(F.try_element_at(both(r), F.lit(2)))))))


def without_roles(df: DataFrame, turns_: str, roles: list[str], role_field: str = "from") -> DataFrame:
    """Conversations of some turns, none of them in these roles."""
    return df.where(F.coalesce((F.size(turns_) > 0) & ~F.exists(turns_, lambda t: t[role_field].isin(*roles)), F.lit(False)))


def code_solution(output: Column | str, none: str = "NO SOLUTION") -> Column:
    """The last fenced block of a program's kind, stripped."""
    return F.coalesce(strip(F.try_element_at(F.regexp_extract_all(col(output), F.lit("(?s)```(?:python)?(.*?)```"), F.lit(1)), F.lit(-1))), F.lit(none))


# verifiable prompts


def long_form_answers(df: DataFrame, question: str, annotations: str, dataset: str, field: str = "long_answer") -> DataFrame:
    """Questions with the first annotation's long answer as their label."""
    first = F.try_element_at(F.col(annotations), F.lit(1))[field]
    return df.withColumn("messages", turns(("user", F.col(question)))).withColumn("ground_truth", first).withColumn("dataset", F.lit(dataset))


def split_rationale(df: DataFrame, question: str = "question", answer: str = "answer", mark: str = "####") -> DataFrame:
    """Word problems whose answer stands behind a mark."""
    parts = split_plain(answer, mark)
    return df.withColumn("messages", turns(("user", F.col(question)))).withColumn("rationale", strip(parts[0])).withColumn("ground_truth", F.array(strip(F.element_at(parts, -1))))


def json_answers(df: DataFrame, question: str, answers: str) -> DataFrame:
    """Questions whose label is a JSON array of all answers."""
    return df.withColumn("messages", turns(("user", F.col(question)))).withColumn("ground_truth", F.to_json(F.col(answers)))


def lettered_choices(df: DataFrame, question: str, correct: str, wrong: list[str]) -> DataFrame:
    """Multiple choice: choices ordered regardless of case, named A, B, ...; the label is the right one's letter."""
    sorted_ = F.array_sort(F.array(F.col(correct), *[F.col(w) for w in wrong]), lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0))
    letter = lambda i: F.char(F.lit(65) + i)
    listed = F.array_join(F.transform(sorted_, lambda c, i: F.concat(letter(i), F.lit(") "), c)), "\n")
    return df.withColumn("messages", turns(("user", F.concat_ws("\n\n", F.col(question), listed)))).withColumn("ground_truth", F.array(letter(F.array_position(sorted_, F.col(correct)).cast("int") - 1)))


def target_lengths(df: DataFrame, key: str, low: int, high: int, seed: int = 1, step: int = 1) -> DataFrame:
    """A stable pseudo-random target length for each key, named in the prompt's last line."""
    length = F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), key), F.lit((high - low) // step + 1)).cast("int") * step
    return df.withColumn("target_length", length)


def few_shot(df: DataFrame, prompt: str, examples: list[tuple[str, str]], template: str = "Question: {q}\nAnswer: {a}\n\n") -> DataFrame:
    """Prompts behind fixed worked examples."""
    head = "".join(template.replace("{q}", q).replace("{a}", a) for q, a in examples)
    return df.withColumn("messages", turns(("user", F.concat(F.lit(head), F.lit(template.split("{q}")[0]), F.col(prompt)))))


def random_template(df: DataFrame, key: str, templates: list[str], columns: list[str], seed: int = 1, out: str = "prompt") -> DataFrame:
    """One of several templates for each key, by a stable hash."""
    pick = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(templates)))
    text = F.element_at(F.array(*[fill(t, **{c: c for c in columns}) for t in templates]), (pick + 1).cast("int"))
    return df.withColumn(out, text)


def prompt_completion(df: DataFrame, prompt: str, completion: str, template: str = "{prompt}") -> DataFrame:
    """prompt and completion as text, the prompt within a template."""
    return df.select("*", F.replace(F.lit(template), F.lit("{prompt}"), F.col(prompt).cast("string")).alias("_p"), F.col(completion).cast("string").alias("_c")).drop(prompt, completion).withColumnsRenamed({"_p": "prompt", "_c": "completion"})


def replicate(df: DataFrame, times: int, key: str = "id") -> DataFrame:
    """Every row ``times`` times, ids numbered behind a dash."""
    return df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(key, F.concat_ws("-", F.col(key).cast("string"), F.col("_k").cast("string"))).drop("_k")


def enumerate_categories(questions: DataFrame, categories: DataFrame, n: int, number: str = "n") -> DataFrame:
    """Question numbers with the category n mod the count and the difficulty (n div the count) mod 10, plus 1.

    ``categories`` has an index column i from 0.
    """
    low = questions.withColumn("difficulty", (F.floor(F.col(number) / n) % 10 + 1).cast("int")).withColumn("i", F.col(number) % n)
    return low.join(categories, "i").drop("i")


def persona_prompts(personas: DataFrame, templates: DataFrame, persona: str = "persona", template: str = "template", block: int = 1000) -> DataFrame:
    """Every template filled with every persona, which is the feature; templates go to the personas in blocks."""
    kept = templates.select(template)
    parts = max(1, -(-kept.count() // block))
    part = F.pmod(F.xxhash64(template), F.lit(parts))
    out = None
    for b in range(parts):
        rows = [r[0] for r in kept.where(F.coalesce(part, F.lit(0)) == b).collect()]  # about ``block`` texts
        if rows:
            one = personas.withColumn(template, F.explode(F.array(*[F.lit(r) for r in rows]))).withColumn("prompt", F.replace(F.col(template), F.lit("{persona}"), F.col(persona)))
            out = one if out is None else out.unionByName(one)
    return personas.limit(0).withColumn(template, F.lit("")).withColumn("prompt", F.lit("")) if out is None else out


def explode_completions(df: DataFrame, messages: str = "messages", completions: str = "completions", reference: str | None = None) -> DataFrame:
    """A conversation for each completion of a prompt, the reference completion among them if there is one."""
    every = F.col(completions) if reference is None else F.concat(completions, F.when(F.col(reference).isNotNull(), F.array(reference)).otherwise(F.array().cast("array<string>")))
    prompt = without_last_answer(messages)
    return df.select("*", F.posexplode(every).alias("completion_index", "completion")).withColumn(messages, F.concat(prompt, F.array(message("assistant", F.col("completion")))))
