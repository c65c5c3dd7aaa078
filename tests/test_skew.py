"""One household, unit and score with about a third of all rows."""
import pytest
from pyspark.sql import functions as F

from rotapanel.functions.running import quantiles
from rotapanel.operators.design import SurveyDesign
from rotapanel.operators.estimation import survey_total
from rotapanel.operators.longitudinal import person_panel
from rotapanel.operators.overlap import seen_in_all, shared_units
from rotapanel.operators.propensity import auc

ROWS = 30_000


@pytest.fixture(scope="module")
def crowded(spark):
    k = F.col("id")
    hot = k % 3 == 0
    home = F.when(hot, 0).otherwise(k % 997 + 1)
    return spark.range(ROWS).select(
        F.when(k % 2 == 0, "T1").otherwise("T2").alias("trimestre"),
        home.cast("long").alias("id_hogar"),
        (F.floor(k / 7) % 9000).cast("int").alias("id_pers"),
        (home % 40).cast("long").alias("upm"),
        (home % 40 % 4).cast("string").alias("estrato"),
        F.lit(2.0).alias("fep"),
        F.when(hot, 0.5).otherwise(k % 1009 / 1009.0).alias("s"),
        (k % 5 == 0).cast("int").alias("y"),
    ).dropDuplicates(["trimestre", "id_hogar", "id_pers"]).cache()


def test_panel_links_every_row(crowded):
    pdf = crowded.toPandas()
    t1, t2 = pdf[pdf.trimestre == "T1"], pdf[pdf.trimestre == "T2"]
    homes = set(t1.id_hogar) & set(t2.id_hogar)
    persons = set(zip(t1.id_hogar, t1.id_pers)) & set(zip(t2.id_hogar, t2.id_pers))
    got = person_panel(crowded, "T1", "T2", 0.5).toPandas()
    assert len(got) == pdf.id_hogar.isin(homes).sum() and (got.fep_long == 4.0).all()
    flagged = got[got.respboth_per == 1]
    assert set(zip(flagged.id_hogar, flagged.id_pers)) == persons and len(flagged) == 2 * len(persons)
    assert seen_in_all(crowded, ["id_hogar"], ["T1", "T2"]).count() == len(homes)
    assert shared_units(crowded, ["id_hogar", "id_pers"]).first().traslape == len(persons)


def test_totals_with_a_crowded_unit(crowded):
    pdf = crowded.toPandas()
    want = 0.0
    for _, rows in pdf.groupby("estrato"):
        z = rows.groupby("upm").fep.sum().to_numpy()
        want += len(z) / (len(z) - 1) * ((z - z.mean()) ** 2).sum()
    got = survey_total(SurveyDesign(crowded, "fep")).first()
    assert got.total == pdf.fep.sum() and got["var"] == pytest.approx(want)


def test_ranks_with_a_crowded_score(crowded):
    pdf = crowded.toPandas()
    ranks = pdf.s.rank()
    n1, n0 = (pdf.y == 1).sum(), (pdf.y == 0).sum()
    want = (ranks[pdf.y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert auc(crowded, "y", "s").first().auc == pytest.approx(want)
    row = quantiles(crowded, "s", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()
    assert [row.q1, row.q2, row.q3] == pytest.approx(list(pdf.s.quantile([0.25, 0.5, 0.75])))
