"""Prompt text and token-list features (M14–M19) as JVM column expressions.

Learned tokenizers are not built (they need model files); these are the
table maths around them: cleaning, templates, padding, masks, id remaps and
action-text extraction. Every function works on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epiframe.functions.vectors import _c, discretize

# Fixed value: every character that ``str.strip()`` strips at both ends.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
            "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_ws(x) -> Column:
    """``str.strip()`` for these whitespace characters (``btrim``: one linear scan, no regex)."""
    return F.btrim(_c(x), F.lit(WS_CHARS))


def clean_prompt_a(x) -> Column:
    """M14 A: strip, '_' → ' ', newline → ' '."""
    return F.translate(strip_ws(x), "_\n", "  ")


def clean_prompt_b(x) -> Column:
    """M14 B: lower-case, strip, '_' → ' ' (newlines kept)."""
    return F.translate(strip_ws(F.lower(_c(x))), "_", " ")


def state_string(state, bins: int = 256) -> Column:
    """Discretised state as space-joined integers."""
    return F.array_join(F.transform(discretize(state, bins), lambda v: v.cast("string")), " ")


def prompt_with_state(prompt, state, with_action_marker: bool = True) -> Column:
    """``Task: <clean>, State: <bins>;\\n`` (+ ``Action: `` for the first template)."""
    tail = ";\nAction: " if with_action_marker else ";\n"
    clean = clean_prompt_a(prompt) if with_action_marker else clean_prompt_b(prompt)
    return F.concat(F.lit("Task: "), clean, F.lit(", State: "), state_string(state), F.lit(tail))


def code_points(x) -> Column:
    """One id per character: the stand-in where no learned tokenizer is given."""
    return F.transform(F.filter(F.split(_c(x), ""), lambda c: c != ""), lambda c: F.ascii(c))


def pad_tokens(tokens, max_len: int) -> tuple[Column, Column, Column]:
    """(tokens padded with 0 / truncated to ``max_len``, mask, truncated flag)."""
    t = _c(tokens)
    n = F.size(t)
    pad = F.greatest(F.lit(max_len) - n, F.lit(0))
    out = F.concat(F.slice(t, 1, max_len), F.array_repeat(F.lit(0), pad))
    mask = F.concat(F.array_repeat(F.lit(True), F.least(n, F.lit(max_len))), F.array_repeat(F.lit(False), pad))
    return out, mask, n > F.lit(max_len)


def prefix_masks(prefix_len, postfix_len, max_len: int) -> tuple[Column, Column, Column]:
    """(token mask, ar mask 0/1, loss mask F/T) for a prefix and postfix, padded/truncated."""
    p, q = _c(prefix_len), _c(postfix_len)
    pad = F.greatest(F.lit(max_len) - p - q, F.lit(0))
    token = F.slice(F.concat(F.array_repeat(F.lit(True), p + q), F.array_repeat(F.lit(False), pad)), 1, max_len)
    ar = F.slice(F.concat(F.array_repeat(F.lit(0), p), F.array_repeat(F.lit(1), q), F.array_repeat(F.lit(0), pad)),
                 1, max_len)
    loss = F.slice(F.concat(F.array_repeat(F.lit(False), p), F.array_repeat(F.lit(True), q),
                            F.array_repeat(F.lit(False), pad)), 1, max_len)
    return token, ar, loss


def extract_action_text(text) -> Column:
    """Text after the first ``Action: `` up to the next ``Action: `` or ``|``, stripped; '' if absent."""
    t = _c(text)
    body = F.split_part(F.split_part(t, F.lit("Action: "), F.lit(2)), F.lit("|"), F.lit(1))
    return F.when(F.contains(t, F.lit("Action: ")), strip_ws(body)).otherwise(F.lit(""))
