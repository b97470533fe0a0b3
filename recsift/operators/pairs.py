"""Training-pair builders: review–metadata pairs (D10), training rows
and masked-token rows (D22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import CLS_ID, MASK_ID, PAD_ID, SEP_ID, VOCAB_SIZE
from .sampling import hash_sample
from .textprep import clean_item_text_pretrain, clean_review_text, latest_by


def build_pretrain_pairs(reviews: DataFrame, items: DataFrame, t_valid: int, downsample: int = 10,
                         seed: int = 42, min_chars: int = 30, user: str = "user_id",
                         item: str = "parent_asin", ts: str = "timestamp",
                         item_order: str | None = None) -> DataFrame:
    """Cleaned (review, metadata) pairs for pre-training.

    Metadata: D9 text, kept when longer than ``min_chars`` (P5). Reviews: D9
    text; kept when in the seeded 1-in-``downsample`` sample (P6), older than
    ``t_valid``, their item has kept metadata (J1) and the text is longer than
    ``min_chars`` (P4). Filters run before the join; the join is an equi-join
    on the item (AQE picks broadcast or shuffle from the runtime size).
    ``item_order`` names the column (category file number) by which the later row of a
    repeated item wins; without it items must be unique.
    """
    if item_order is not None:  # J2: an item met in several files takes the later one
        items = latest_by(items, item, item_order, [c for c in items.columns if c not in (item, item_order)])
    meta = _longer(clean_item_text_pretrain(items, item, "meta"), [item], "meta", min_chars)
    rv = hash_sample(reviews.filter(F.col(ts) < F.lit(t_valid)), [user, item], downsample, seed)
    rv = _longer(clean_review_text(rv, out="review"), [user, item], "review", min_chars)
    return rv.join(meta, item)


def _longer(df: DataFrame, keep: Sequence[str], text: str, min_chars: int) -> DataFrame:
    """``keep`` and ``text`` of the rows whose text is longer than ``min_chars``. A filter on a computed column makes
    Spark compute it for the filter and again for the output; an exploded one is computed once."""
    return df.select(*keep, F.explode(F.array(text)).alias(text)).filter(F.length(text) > min_chars)


def make_training_rows(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One column → (x, x) (unsupervised); two → a pair; three → a pair
    plus a hard negative. Missing text becomes one space. ``keep`` columns
    are carried along."""
    fill = [F.coalesce(F.col(c), F.lit(" ")) for c in cols]
    k = [F.col(c) for c in keep]
    if len(cols) == 1:
        return df.select(*k, fill[0].alias("sent0"), fill[0].alias("sent1"))
    if len(cols) == 2:
        return df.select(*k, fill[0].alias("sent0"), fill[1].alias("sent1"))
    if len(cols) == 3:
        return df.select(*k, fill[0].alias("sent0"), fill[1].alias("sent1"), fill[2].alias("hard_neg"))
    raise ValueError("training rows take 1, 2 or 3 text columns")


def _h(key: Column, pos: Column, seed: int) -> Column:
    s = F.concat_ws("|", key.cast("string"), pos.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def mask_tokens(df: DataFrame, key: str, ids: str = "input_ids", p: float = 0.15, seed: int = 42,
                vocab_size: int = VOCAB_SIZE, special: Sequence[int] = (PAD_ID, CLS_ID, SEP_ID),
                mask_id: int = MASK_ID) -> DataFrame:
    """Masked-LM inputs. A non-special position is chosen with
    probability ``p`` (seeded per (row, position)); of the chosen, 80 % become
    ``mask_id``, 10 % a random id, 10 % stay. Labels hold the original id at
    chosen positions and -100 elsewhere."""
    thresh = int(round(p * 10000))
    sp = F.array(*[F.lit(s).cast("bigint") for s in special])
    k = F.col(key)

    def chosen(x, i):
        return (~F.array_contains(sp, x)) & (F.pmod(_h(k, i, seed), F.lit(10000)) < thresh)

    def new_id(x, i):
        v = F.pmod(_h(k, i, seed + 1), F.lit(10))
        rnd = F.pmod(_h(k, i, seed + 2), F.lit(vocab_size))
        return (F.when(~chosen(x, i), x).when(v < 8, F.lit(mask_id).cast("bigint"))
                .when(v == 8, rnd).otherwise(x))

    return df.withColumn("mlm_input_ids", F.transform(ids, new_id)).withColumn(
        "mlm_labels", F.transform(ids, lambda x, i: F.when(chosen(x, i), x).otherwise(F.lit(-100).cast("bigint"))))
