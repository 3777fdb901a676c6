"""Fill-in-the-middle rewriting of whole texts by block rotation in place, and the way back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaspark.llm.common import as_bytes

SEED, RATE, SPM_RATE = 42, 50, 80
#: Sentinels in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Middle(NamedTuple):
    """A rewritten text: number of units, form, code points of prefix and middle (None if plain), bytes of the output."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def unit_ends(text: bytes) -> np.ndarray:
    """End offset of each unit: a run of other bytes with the white space before it; white space at the end is a unit of its own."""
    if not text:
        return np.zeros(0, np.int64)
    space = _SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers that the seed and the id decide; a null id counts as the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4)]


def _reverse(view: np.ndarray) -> None:
    """Reverse in place, in pieces, so that no second copy of a long block exists."""
    low, high = 0, len(view)
    while high - low > 1:
        step = min((high - low) // 2, 1 << 16)
        head = view[low:low + step].copy()
        view[low:low + step] = view[high - step:high][::-1]
        view[high - step:high] = head[::-1]
        low, high = low + step, high - step


def rotate(buffer: bytearray, start: int, cut: int, stop: int) -> None:
    """Exchange the blocks [start, cut) and [cut, stop) by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view[start:cut])
    _reverse(view[cut:stop])
    _reverse(view[start:stop])


def _chars(view: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((view & 0xC0) != 0x80))


def rewrite(text: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> Middle:
    """Cut a text at two drawn unit ends and move its parts behind sentinels.

    ``rate`` percent of the texts change, ``spm_rate`` percent of those get the
    suffix first. Empty texts and texts that hold a sentinel stay plain, so the
    output can always be told apart again.
    """
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return Middle(n, "plain", None, None, text)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, last))
    whole = np.frombuffer(text, np.uint8)
    prefix_chars, middle_chars = _chars(whole[:a]), _chars(whole[a:b])
    buffer = bytearray(text)
    # from the back, so that the offsets in front stay right: <P>prefix<M>middle<S>suffix
    buffer[b:b] = SUFFIX
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    spm = h4 % 100 < spm_rate
    rotate(buffer, 0 if spm else middle, suffix, len(buffer))
    return Middle(n, "spm" if spm else "psm", prefix_chars, middle_chars, bytes(buffer))


def restore(output: bytes, form: str) -> bytes:
    """The text before :func:`rewrite`, from its output and form alone. Raises ValueError where the sentinels are missing."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    p, s, m = buffer.index(PREFIX), buffer.index(SUFFIX), buffer.index(MIDDLE)
    if form == "spm":  # <S>suffix <P>prefix<M>middle: the last two parts return to the front
        rotate(buffer, 0, p, len(buffer))
        middle, suffix = m - p, len(buffer) - p
    else:  # <P>prefix <S>suffix <M>middle
        rotate(buffer, s, m, len(buffer))
        middle, suffix = s, s + len(buffer) - m
    del buffer[suffix:suffix + len(SUFFIX)]
    del buffer[middle:middle + len(MIDDLE)]
    del buffer[:len(PREFIX)]
    return bytes(buffer)


def _selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _ids(batch: pd.DataFrame) -> list[int | None]:
    return [None if pd.isna(i) else int(i) for i in batch["doc_id"]]


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the rewritten texts, a row per document.

    No shuffle; a task holds one Arrow batch and one text at a time besides it.
    A null text counts as empty and stays plain, a null id draws as the empty
    string, repeated ids draw alike, other columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [rewrite(t, i, seed, rate, spm_rate) for t, i in zip(as_bytes(batch["text"]), _ids(batch), strict=True)]
            frame = pd.DataFrame(made, columns=Middle._fields).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            frame["output"] = [m.output.decode() for m in made]
            yield frame.assign(doc_id=batch["doc_id"].array)

    return _selected(docs, id_col, text_col).mapInPandas(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame) -> DataFrame:
    """(doc_id, text): the original texts of a result of :func:`fill_middle`; only ``output`` and ``form`` are read. A null output gives an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [restore(o, f).decode() for o, f in zip(as_bytes(batch["output"]), batch["form"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return made.select("doc_id", "output", "form").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: :func:`rewrite` and :func:`restore` in one pass, for checks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, doc_id in zip(as_bytes(batch["text"]), _ids(batch), strict=True):
                made = rewrite(text, doc_id)
                back = restore(made.output, made.form)
                rows.append((*made[:4], hashlib.sha256(made.output).hexdigest(), hashlib.sha256(back).hexdigest()))
            frame = pd.DataFrame(rows, columns=[*Middle._fields[:4], "output_sha256", "restored_sha256"])
            yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"}).assign(doc_id=batch["doc_id"].array)

    return _selected(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    )


SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h
  from documents),
drawn as (
  select doc_id, text, units, len(units) as n, ('0x' || h[1:8])::bigint % (len(units) + 1) as u, ('0x' || h[9:16])::bigint % (len(units) + 1) as v,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from cut),
parts as (
  select *, array_to_string(units[1:least(u, v)], '') as p, array_to_string(units[least(u, v) + 1:greatest(u, v)], '') as m,
    array_to_string(units[greatest(u, v) + 1:], '') as s
  from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
