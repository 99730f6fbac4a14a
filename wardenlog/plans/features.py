"""The batch feature plan: clean, learn baselines on the training part, derive features, encode, order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.timeline import HotKeys, find_hot_keys
from ..operators import baseline, clean, features, windows
from ..scratch import written


@dataclass
class Fitted:
    """What a later run or a stream needs of the training part."""

    cut: clean.Cut
    baselines: DataFrame
    known: DataFrame
    vocabulary: DataFrame


def fit(log: DataFrame, train_ratio: float = 0.60) -> Fitted:
    cut = clean.find_cut(log, train_ratio)
    train = log.where(cut.is_train())
    # Small tables that every later step joins: written once.
    return Fitted(
        cut, written(baseline.entity_baselines(train), "baselines"), written(baseline.known_values(train), "known-values"),
        written(clean.fit_categories(log), "vocabulary"),
    )


def engineered(
    log: DataFrame, fitted: Fitted | None = None, hot_entities: HotKeys | None = None, hot_ips: HotKeys | None = None
) -> DataFrame:
    """Engineered data set of a cleaned, labelled log; best a written one, as it is read for each of the shuffles.

    Shuffles of the log: by entity (previous event), by values (novelty and baseline, unless small enough to
    broadcast), by entity (rolling frames) and by address (rolling frames).
    """
    fitted = fitted or fit(log)
    hot_entities = hot_entities if hot_entities is not None else find_hot_keys(log, "entity_id")
    hot_ips = hot_ips if hot_ips is not None else find_hot_keys(log, "source_ip")
    out = features.event_features(log, fitted.baselines, fitted.known, hot_entities)
    out = windows.window_features(out, hot_entities, hot_ips, source=log)
    out = clean.encode_categories(out, fitted.vocabulary)
    return clean.order_columns(out)
