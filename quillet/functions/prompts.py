"""Prompt templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import with_suffix

# The wording of the prompts.
HEAD = """Below is an instruction that describes a task, paired with an input that provides further context. 
Write a response that appropriately completes the request. 
Before answering, think carefully about the task and create a step-by-step chain of thoughts to ensure a logical and accurate response.

### Instruction:
You are a reverse engineering expert with advanced knowledge in assembly and {}. 
Please convert the following assembly code to idiomatic and clear {} code. 

### Assembly:
{}

### Response:
"""
OPEN_THINK = "<think>\n"
FENCED = "```{}\n{}\n```\n"
THOUGHT = "<think>\n{}\n</think>\n"


def fill(template: str, *slots: Column) -> Column:
    """template with its {} replaced by columns in order."""
    parts = template.split("{}")
    if len(parts) != len(slots) + 1:
        raise ValueError(f"{len(parts) - 1} slots, {len(slots)} values")
    out = [F.lit(parts[0])]
    for slot, text in zip(slots, parts[1:], strict=True):
        out += [slot, F.lit(text)]
    return F.concat(*out)


def inference_prompt(language: Column, assembly: Column, eos: str = "", thinking: bool = False) -> Column:
    return F.concat(fill(HEAD + (OPEN_THINK if thinking else ""), language, language, assembly), F.lit(eos))


def training_prompt(language: Column, assembly: Column, source: Column, eos: str, reasoning: Column | None = None) -> Column:
    answer = (F.lower(language), with_suffix(source, eos))
    if reasoning is None:
        return fill(HEAD + FENCED, language, language, assembly, *answer)
    return fill(HEAD + THOUGHT + FENCED, language, language, assembly, reasoning, *answer)
