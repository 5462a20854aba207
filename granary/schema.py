"""Types of the data model: messages, conversations, preference pairs, rollouts, token sequences, evaluation records."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
CONVERSATION = T.StructType([T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("messages", MESSAGES)])
PREFERENCE = T.StructType([T.StructField("chosen", MESSAGES), T.StructField("rejected", MESSAGES), T.StructField("chosen_score", T.DoubleType()), T.StructField("rejected_score", T.DoubleType())])
VERIFIABLE = T.StructType([T.StructField("messages", MESSAGES), T.StructField("ground_truth", T.ArrayType(T.StringType())), T.StructField("dataset", T.ArrayType(T.StringType()))])
TOKENS = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("input_ids", "attention_mask", "labels")])
PREDICTION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "category", "unit", "problem", "solution", "evaluation_method", "output")] + [T.StructField("parsed_final_answers", T.ArrayType(T.StringType()))]
)
TRACE = T.StructType(
    [T.StructField("training_step", T.IntegerType()), T.StructField("scores", T.ArrayType(T.DoubleType()))]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("responses", "queries", "ground_truths", "datasets", "finish_reasons")]
    + [T.StructField("reward_metrics", T.MapType(T.StringType(), T.DoubleType()))]
)
ANNOTATION = T.StructType(
    [T.StructField("instance_index", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("instance_id", "prompt", "model_a", "model_b", "completion_a", "completion_b", "completion_a_is_acceptable", "completion_b_is_acceptable", "preference", "instance_quality", "comments", "evaluator", "timestamp")]
)
REPLY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("message_id", "parent_id", "role", "text")]
    + [T.StructField("deleted", T.BooleanType()), T.StructField("labels", T.StructType([T.StructField("name", T.ArrayType(T.StringType())), T.StructField("value", T.ArrayType(T.DoubleType()))]))]
)
QUESTION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "category", "unit")]
    + [T.StructField("difficulty", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("problem", "solution_cot", "expected_answer")]
    + [T.StructField("is_valid", T.IntegerType()), T.StructField("validation_cot", T.StringType())]
)

#: Label of a token that takes no part in the loss.
MASKED = -100
