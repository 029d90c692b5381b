"""Fixed-length token sequences as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the special tokens and the sequence length.
PAD, UNK, BOS, EOS = 0, 1, 2, 3
MAX_LEN = 32


def pack(ids: Column, max_len: int = MAX_LEN) -> Column:
    """Cut the body to ``max_len - 2`` ids, add BOS and EOS, pad on the right."""
    room = max_len - 2
    padding = F.array_repeat(F.lit(PAD), room - F.least(F.size(ids), F.lit(room)))
    return F.concat(F.array(F.lit(BOS)), F.slice(ids, 1, room), F.array(F.lit(EOS)), padding)


def decoder_input(packed: Column) -> Column:
    """All ids but the last."""
    return F.slice(packed, 1, F.size(packed) - 1)


def decoder_target(packed: Column) -> Column:
    """All ids but the first."""
    return F.slice(packed, 2, F.size(packed) - 1)


def padding_mask(packed: Column) -> Column:
    """True where the position is padding."""
    return F.transform(packed, lambda i: i == PAD)


def unknown_count(ids: Column) -> Column:
    return F.size(F.filter(ids, lambda i: i == UNK))


def shared_ids(left: Column, right: Column) -> Column:
    """Ids that occur in both encodings, ascending."""
    return F.array_sort(F.array_intersect(left, right))
