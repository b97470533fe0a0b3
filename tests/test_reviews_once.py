"""Review lines are parsed once."""

from recsift.sources.readers import read_reviews_jsonl


def _plan(df, optimized=False):
    q = df._jdf.queryExecution()
    return (q.optimizedPlan() if optimized else q.executedPlan()).toString()


def test_reviews_are_parsed_once_as_numbers_and_again_only_in_other_forms(spark, tmp_path):
    lines = ['{"user_id":"u","parent_asin":"i","rating":5.0,"sortTimestamp":12}',
             '{"user_id":7,"parent_asin":"i","rating":"4","sortTimestamp":"13"}',
             '{"user_id":"u","parent_asin":"i","rating":3,"sortTimestamp":-1.9}',
             '{"user_id":"u","parent_asin":"i","rating":"NaN","sortTimestamp":1e3}',
             '{"user_id":"u","parent_asin":"i","rating":3,"sortTimestamp":"1.5"}',
             '{"user_id":"u","parent_asin":"i","rating":"x","sortTimestamp":1}',
             '{"user_id":"u","rating":3,"sortTimestamp":1}', '{"user_id":"u","parent_asin":"i","rating":null,"sortTimestamp":1}',
             "{broken", "  ", ""]
    (tmp_path / "r.txt").write_text("\n".join(lines))
    good, bad = read_reviews_jsonl(spark, str(tmp_path))
    assert sorted((r.user_id, str(r.rating), r.timestamp) for r in good.collect()) == [
        ("7", "4.0", 13), ("u", "3.0", -1), ("u", "5.0", 12), ("u", "nan", 1000)]
    assert sorted(r.line for r in bad.collect()) == sorted(lines[4:9])
    # one parse as numbers and one as text (evaluated only where the first is not whole), none in the filters
    assert _plan(good, optimized=True).count("from_json(") == 2
