"""Cutting texts into units that tokenizers treat alone.

A space is put before a text, and the result is cut before every space or line feed that follows
a character which is no white space. No rule of the byte-level pattern reaches over such a place, since a run of white space begins a new match,
and no piece of a marked vocabulary does, since a mark only stands at a piece's beginning and a line feed in none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
#: White space of any tokenizer, and the mark, which stands for a space.
_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2581}"
_CUT, _RUN = rf"([^{_SPACE}])([ \n])", rf"[{_SPACE}][ \n]"


def cut_units(texts: pa.StringArray, cut: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units, the place among them of every unit of all texts one after another, and how many units each text has.

    Null and empty texts have none. Without ``cut`` a text is one unit.
    """
    texts = pa.concat_arrays([texts])  # if_else with a null arm is wrong on slices
    known = pc.if_else(pc.equal(texts, ""), None, texts)
    spaced = pc.binary_join_element_wise(" ", known, "")
    between = next(s for s in (f"\ue000{k}" for k in itertools.count()) if not pc.any(pc.match_substring(spaced, s)).as_py())
    if cut:  # plain replacement is faster, and right where no white space follows white space
        runs = pc.match_substring_regex(spaced, _RUN)
        plain = pc.replace_substring(pc.replace_substring(pc.if_else(runs, None, known), " ", f"{between} "), "\n", f"{between}\n")
        regex = pc.replace_substring_regex(pc.if_else(runs, spaced, None), _CUT, rf"\1{between}\2")
        spaced = pc.coalesce(regex, pc.binary_join_element_wise(" ", plain, ""))
    lists = pc.split_pattern(spaced, between)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that pick runs of given starts and sizes one after another, and where each run begins (with the end of all)."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes), ends


def pieces_may_be_cut(model) -> bool:
    """No piece holds a mark behind another character, nor a line feed."""
    pieces = (model.id_to_piece(k) for k in range(model.vocab_size()))
    return not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)


def piece_ids(model, mark: int, units: list[str]) -> list[list[int]]:
    """Ids of units by the sentencepiece library. It puts the first mark itself; before a line feed that is a piece of its own, which goes."""
    found = model.encode([u if u[0] == "\n" else u[1:] for u in units], num_threads=1)
    return [ids[1:] if u[0] == "\n" else ids or [mark] for u, ids in zip(units, found)]
