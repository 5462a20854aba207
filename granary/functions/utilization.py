"""Cost of decoder-only models in operations and bytes, and the shares of a device's peak that a run reaches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """Sizes of a decoder; ``window`` bounds attention in the layers that slide."""

    layers: int
    hidden: int
    intermediate: int
    vocabulary: int
    heads: int
    kv_heads: int
    head_dim: int
    window: int | None = None
    sliding_layers: int = 0
    bytes_per_value: int = 2

    def layer_weights(self) -> int:
        """Values in one layer: query, key, value and output projections, and the gated feed-forward part."""
        q, kv = self.heads * self.head_dim, self.kv_heads * self.head_dim
        return self.hidden * (q + 2 * kv) + q * self.hidden + 3 * self.hidden * self.intermediate

    def weights(self) -> int:
        return self.layers * self.layer_weights() + self.vocabulary * self.hidden

    def attention_flops(self, queries: Column, keys: Column) -> Column:
        """Scores and weighted sums of ``queries`` tokens over ``keys`` tokens, in all layers."""
        one = 4 * self.heads * self.head_dim * queries
        near = F.least(keys, F.lit(self.window)) if self.window else keys
        return one * (keys * (self.layers - self.sliding_layers) + near * self.sliding_layers)

    def prefill_flops(self, prompt: Column) -> Column:
        """All of a prompt at once, with logits for its last token."""
        return 2.0 * self.layers * self.layer_weights() * prompt + self.attention_flops(prompt, prompt) + 2 * self.hidden * self.vocabulary

    def decode_flops(self, prompt: Column, response: Column) -> Column:
        """One token after the other; keys grow from the prompt's by one."""
        mean = prompt + (response + 1) / 2
        return response * (2.0 * self.weights()) + self.attention_flops(response, mean)

    def kv_bytes(self, tokens: Column) -> Column:
        return 2.0 * self.layers * self.kv_heads * self.head_dim * self.bytes_per_value * tokens

    def decode_bytes(self, prompt: Column, response: Column, samples: Column) -> Column:
        """Weights once per step for all samples, keys and values of each sample at each step."""
        reads = samples * response * self.kv_bytes(prompt + (response - 1) / 2)
        return response * float(self.weights() * self.bytes_per_value) + reads + samples * self.kv_bytes(response)


def flops_share(flops: Column, seconds: Column, devices: Column, peak: float) -> Column:
    """Percent of the peak operations that a run did."""
    return 100.0 * flops / (seconds * devices * peak)


def bytes_share(read: Column, seconds: Column, devices: Column, peak: float) -> Column:
    """Percent of the peak bandwidth that a run used."""
    return 100.0 * read / (seconds * devices * peak)
