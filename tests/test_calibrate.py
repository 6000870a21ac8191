import random

import pytest
from pyspark.sql import functions as F

from ticketflow.operators import audits, calibrate, score, thresholds

SCHEMA = "id long, truth string, prediction string, confidence double"


def rows(n=4000, seed=1):
    """Confidence c is right in c * c of all cases."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c = round(rng.random(), 3)
        out.append((i, "a" if rng.random() < c * c else "b", "a", c))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    odd = [(-1, "a", "a", None), (-2, "a", "a", float("nan")), (-3, None, "a", 0.5), (-4, "a", None, 0.5), (-5, "a", "a", 0.5), (-6, "b", "a", -0.0)]
    return spark.createDataFrame(rows() + odd, SCHEMA)


def pooled(counts):
    """Pool adjacent violators over sorted (confidence, n, right)."""
    blocks = []
    for c, n, right in counts:
        blocks.append([right, n, [c]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            right, n, cs = blocks.pop()
            blocks[-1][0] += right
            blocks[-1][1] += n
            blocks[-1][2] += cs
    return {c: right / n for right, n, cs in blocks for c in cs}


def test_isotonic_fit_equals_pooled_blocks(scored):
    counts = sorted(tuple(r) for r in calibrate.confidence_counts(scored).collect())
    assert sum(c[1] for c in counts) == 4004
    want = pooled(counts)
    model = calibrate.fit_calibration(scored)
    out = calibrate.calibrated(model, scored)
    assert out.columns == ["id", "truth", "prediction", "raw_confidence", "confidence"]
    got = {r.raw_confidence + 0.0: r.confidence for r in out.filter(calibrate.usable("raw_confidence")).collect()}
    assert got == pytest.approx(want)
    values = [got[c] for c in sorted(got)]
    assert values == sorted(values)
    missing = {r.id: r.confidence for r in out.filter("id in (-1, -2)").collect()}
    assert missing[-1] is None and missing[-2] != missing[-2]


def test_calibration_helps_on_other_rows(spark, scored):
    model = calibrate.fit_calibration(scored)
    other = calibrate.calibrated(model, spark.createDataFrame(rows(seed=2), SCHEMA))
    ece = lambda c: audits.calibration_error(audits.reliability_bins(other, confidence=c)).first().ece
    assert ece("confidence") < 0.05 < 0.1 < ece("raw_confidence")


def test_values_between_and_beyond_what_was_seen(spark):
    seen = spark.createDataFrame([(1, "b", "a", 0.2), (2, "a", "a", 0.6)], SCHEMA)
    asked = spark.createDataFrame([(1, "a", "a", 0.1), (2, "a", "a", 0.4), (3, "a", "a", 0.9)], SCHEMA)
    got = calibrate.calibrated(calibrate.fit_calibration(seen), asked).orderBy("id").collect()
    assert [r.confidence for r in got] == pytest.approx([0.0, 0.5, 1.0])
    with pytest.raises(ValueError):
        calibrate.fit_calibration(seen.filter("id > 5"))
    with pytest.raises(ValueError):
        calibrate.calibrated(calibrate.fit_calibration(seen), asked.withColumn("raw_confidence", F.lit(1)))


@pytest.mark.parametrize("ranges", [1, 7, 128])
@pytest.mark.parametrize("inclusive", [False, True])
def test_curve_equals_counting(scored, ranges, inclusive):
    usable = [(r.confidence + 0.0, r.truth is not None and r.truth == r.prediction) for r in scored.filter(calibrate.usable()).collect()]
    got = {r.threshold: r for r in thresholds.threshold_curve(scored, inclusive=inclusive, ranges=ranges).collect()}
    assert set(got) == {c for c, _ in usable}
    hits = sum(r for _, r in usable)
    for t in sorted(got)[::37]:
        above = [r for c, r in usable if (c >= t if inclusive else c > t)]
        line = got[t]
        assert line.automatic == len(above) and line.coverage == pytest.approx(len(above) / len(usable))
        assert line.recall == pytest.approx(sum(above) / hits)
        assert line.precision == (pytest.approx(sum(above) / len(above)) if above else None)


def test_choice_and_ranking(spark, scored):
    curve = thresholds.threshold_curve(scored)
    best = thresholds.choose_threshold(curve, 0.8).first()
    good = [r.threshold for r in curve.collect() if r.precision is not None and r.precision >= 0.8]
    assert best.threshold == min(good) and best.precision >= 0.8
    # deciding with it keeps the promise
    routed = score.route(scored, best.threshold).filter("decision = 'automatic'")
    assert routed.filter("truth = prediction").count() / routed.count() == pytest.approx(best.precision)
    assert thresholds.choose_threshold(curve, 1.1).first().threshold is None
    few = spark.createDataFrame([(1, "a", "a", 0.9), (2, "b", "a", 0.9), (3, "a", "a", 0.5), (4, "b", "a", 0.1)], SCHEMA)
    got = thresholds.ranking_quality(few).first()
    assert (got.n, got.right, got.auc) == (4, 2, pytest.approx((0.5 + 1 + 0 + 1) / 4))
    none = few.filter("id > 9")
    assert thresholds.threshold_curve(none).count() == 0 and thresholds.ranking_quality(none).first().auc is None
