"""Review and adjudication state folded from action streams with
``applyInPandasWithState``; equal to the batch folds on the same log, in whatever order its
events arrive.

The state of a row is the sorted array of its events, packed as ``seq * 8 + code`` (8 bytes an
event), and the text of its last edit. A late event takes its place in the array, a redelivered
one is already there; the folds are closed forms over the array, without a loop over events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from credline.session import ship_package

REVIEW_OUT = ("row_id long, label_adjusted boolean, deleted boolean, annotated boolean, "
              "ocr_accepted boolean")
ADJ_OUT = "row_id long, adjudicated boolean, accepted boolean, n_edits long, edited string"
STATE = "events binary, edit_seq long, edited string"
SWAP, REJECT, DELETE, SUBMIT, UNDO = 1, 2, 3, 4, 5
REVIEW_CODES = {"swap": SWAP, "reject": REJECT, "delete": DELETE, "submit": SUBMIT, "undo": UNDO}
ACCEPT, DECLINE, EDIT, REVOKE = 1, 2, 3, 4
ADJ_CODES = {"accept": ACCEPT, "reject": DECLINE, "edit": EDIT, "undo": REVOKE}


def _merged(pdfs: Iterator[pd.DataFrame], codes: dict[str, int], state: GroupState):
    """The row's events so far, (seq, code) in order, and its last edit (seq, text)."""
    events, edit_seq, edited = state.get if state.exists else (b"", -1, None)
    parts = [np.frombuffer(events, np.int64)]
    for pdf in pdfs:
        pdf = pdf.assign(code=pdf["action"].map(codes)).dropna(subset=["code"])
        parts.append(pdf["seq"].to_numpy(np.int64) * 8 + pdf["code"].to_numpy(np.int64))
        texts = pdf[(pdf["action"] == "edit") & pdf["payload"].notna()]
        if len(texts) and texts["seq"].max() > edit_seq:
            last = texts["seq"].idxmax()
            edit_seq, edited = int(texts["seq"][last]), texts["payload"][last]
    packed = np.unique(np.concatenate(parts))
    state.update((packed.tobytes(), edit_seq, edited))
    return packed // 8, packed % 8, edited


def fold_review_events(seq: np.ndarray, code: np.ndarray) -> tuple[bool, bool, bool, bool]:
    """label_adjusted, deleted, annotated, ocr_accepted of ordered events."""
    commits = np.flatnonzero((code == SUBMIT) | (code == DELETE))
    undos = np.flatnonzero(code == UNDO)
    at = commits[-1] if len(commits) else -1
    since = undos[undos < at][-1] if (undos < at).any() else -1
    rejects = np.count_nonzero(code[since + 1:max(at, 0)] == REJECT)
    return (np.count_nonzero(code == SWAP) % 2 == 1, np.count_nonzero(code == DELETE) % 2 == 1,
            at >= 0 and not (undos > at).any(), at >= 0 and rejects % 2 == 0)


def _review_step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
    seq, code, _ = _merged(pdfs, REVIEW_CODES, state)
    adjusted, deleted, annotated, accepted = fold_review_events(seq, code)
    yield pd.DataFrame({"row_id": [key[0]], "label_adjusted": [adjusted], "deleted": [deleted],
                        "annotated": [bool(annotated)], "ocr_accepted": [bool(accepted)]})


def _adjudication_step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
    _, code, edited = _merged(pdfs, ADJ_CODES, state)
    last = code[-1] if len(code) else 0
    yield pd.DataFrame({"row_id": [key[0]], "adjudicated": [last in (ACCEPT, DECLINE)], "accepted": [last == ACCEPT],
                        "n_edits": [np.count_nonzero(code == EDIT)], "edited": pd.Series([edited], dtype=object)})


def _fold(events: DataFrame, step, out: str) -> DataFrame:
    ship_package(events.sparkSession)
    payload = F.col("payload") if "payload" in events.columns else F.lit(None).cast("string")
    return events.select("row_id", "seq", "action", payload.alias("payload")).groupBy("row_id").applyInPandasWithState(
        step, out, STATE, "Update", GroupStateTimeout.NoTimeout)


def review_state_stream(events: DataFrame) -> DataFrame:
    """Streaming review fold over (row_id, seq, action); ``seq`` is unique within a row."""
    return _fold(events, _review_step, REVIEW_OUT)


def adjudication_state_stream(events: DataFrame) -> DataFrame:
    """Streaming adjudication fold over (row_id, seq, action[, payload])."""
    return _fold(events, _adjudication_step, ADJ_OUT)
