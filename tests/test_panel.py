import pytest
from pyspark.sql import functions as F

from rotapanel.functions.reshape import complete_grid, rename_matching, scale_matching
from rotapanel.operators.flows import allocate_by_weights, flow_table, flow_weights, net_and_gross
from rotapanel.operators.longitudinal import household_panel, persons_of_panel, person_panel, with_person_flag
from rotapanel.operators.overlap import rotation_slots, scheme_overlap, seen_in_all, shared_units, state_spells, trajectories
from rotapanel.sources.microdata import survey_base


def shares(slots):
    return {(r.period_1, r.period_2): r.share for r in scheme_overlap(slots).collect()}


def test_rotation_of_four_consecutive_rounds(spark):
    slots = rotation_slots(spark, stay=4, periods=6)
    by_period = {}
    for r in slots.collect():
        by_period.setdefault(r.period, set()).add(r.panel)
    assert by_period[1] & by_period[2] == by_period[2] - {max(by_period[2])}
    got = shares(slots)
    assert [got[(1, k)] for k in (2, 3, 4, 5)] == [0.75, 0.5, 0.25, 0.0]


def test_rotation_with_a_repeated_round(spark):
    got = shares(rotation_slots(spark, stay=4, field=[1, 2, 2, 3]))
    assert (got[(2, 3)], got[(1, 3)], got[(1, 4)]) == (1.0, 0.75, 0.5)


def test_two_in_two_out(spark):
    got = shares(rotation_slots(spark, stay=2, away=2, spells=2, periods=6))
    assert got[(1, 2)] == 0.5


def test_shared_units_equal_a_self_join(spark, tiny):
    people = survey_base(spark, tiny)
    seen = people.select("id_hogar", "trimestre").distinct()
    a, b = seen.alias("a"), seen.alias("b")
    want = a.join(b, (F.col("a.id_hogar") == F.col("b.id_hogar")) & (F.col("a.trimestre") < F.col("b.trimestre"))).groupBy(
        F.col("a.trimestre").alias("x"), F.col("b.trimestre").alias("y")
    ).count()
    got = {(r.trimestre_1, r.trimestre_2): r.traslape for r in shared_units(people, ["id_hogar"]).collect()}
    assert got == {(r.x, r.y): r["count"] for r in want.collect()}


def test_person_key_does_not_collide(spark):
    # 1 and 11 joined without a separator would equal 11 and 1.
    rows = spark.createDataFrame(
        [("T1", 1, 11), ("T2", 11, 1), ("T1", 5, 1), ("T2", 5, 1)], "trimestre string, id_hogar long, id_pers int"
    )
    flagged = {(r.id_hogar, r.id_pers): r.respboth_per for r in with_person_flag(rows, "T1", "T2").collect()}
    assert flagged == {(1, 11): 0, (11, 1): 0, (5, 1): 1}


def test_duplicate_rows_do_not_count_as_two_rounds(spark):
    rows = spark.createDataFrame([("T1", 1), ("T1", 1), ("T1", 2), ("T2", 2)], "trimestre string, id_hogar long")
    assert [r.id_hogar for r in seen_in_all(rows, ["id_hogar"], ["T1", "T2"]).collect()] == [2]


def test_one_pass_panel_equals_the_step_by_step_panel(spark, sf):
    people = survey_base(spark, sf)
    quick = person_panel(people, "T1", "T2", 0.75).select("id_hogar", "id_pers", "trimestre", "respboth_per")
    steps = with_person_flag(persons_of_panel(people, "T1", "T2"), "T1", "T2").select(quick.columns)
    assert quick.exceptAll(steps).count() == 0 and steps.exceptAll(quick).count() == 0
    panel = household_panel(people, "T1", "T2")
    assert panel.where("respboth = 1 and trimestre = 'T2'").count() == seen_in_all(people, ["id_hogar"], ["T1", "T2"]).count()


def test_spells_cover_every_observation(spark, tiny):
    people = survey_base(spark, tiny)
    spells = state_spells(people, ["id_hogar", "id_pers"], "trabajo")
    assert spells.agg(F.sum("duracion")).first()[0] == people.count()
    kinds = trajectories(spells, ["id_hogar", "id_pers"]).collect()
    assert all(r.trayectoria == "estable" for r in kinds if r.periodos == 1)


def test_weight_difference_allocation(spark):
    # Weights 300 and 305, both ways.
    rows = spark.createDataFrame([("E", "E", 300.0, 305.0)], "s1 string, s2 string, w1 double, w2 double")
    got = {(r.desde, r.hacia): r.monto for r in allocate_by_weights(rows, "s1", "s2", "w1", "w2").collect()}
    assert got == {("E", "E"): 300.0, ("Fuera", "E"): 5.0}
    back = rows.select("s1", "s2", F.col("w2").alias("w1"), F.col("w1").alias("w2"))
    got = {(r.desde, r.hacia): r.monto for r in allocate_by_weights(back, "s1", "s2", "w1", "w2").collect()}
    assert got == {("E", "E"): 300.0, ("E", "Fuera"): 5.0}


FLOWS = [(1, 1, 2.0), (1, 2, 3.0), (2, 2, 4.0), (1, None, 5.0), (None, 1, 6.0), (None, 2, 7.0), (None, None, 8.0)]


def test_corner_of_the_flow_table(spark):
    cells = flow_weights(spark.createDataFrame(FLOWS, "a int, b int, w double"), "a", "b", "w")
    rows = {r.estado: r for r in flow_table(cells, "w", [1, 2]).collect()}
    assert (rows["1"].s_1, rows["1"].s_2, rows["1"].complemento_fila) == (2.0, 3.0, 5.0)
    assert (rows["2"].s_1, rows["2"].complemento_fila) == (0.0, 0.0)
    assert (rows["Complemento columna"].s_1, rows["Complemento columna"].complemento_fila) == (6.0, 8.0)
    summed = {r.estado: r for r in flow_table(cells, "w", [1, 2], corner="column_sum").collect()}
    assert summed["Complemento columna"].complemento_fila == 13.0


def test_net_change_is_inflow_less_outflow(spark):
    cells = flow_weights(spark.createDataFrame(FLOWS, "a int, b int, w double"), "a", "b", "w")
    for r in net_and_gross(cells, "w").collect():
        assert r.cambio_neto == pytest.approx(r.entradas - r.salidas)


def test_grid_keeps_missing_states(spark):
    rows = spark.createDataFrame([(1, None, 4), (2, 2, 5)], "a int, b int, n long")
    got = {(r.a, r.b): r.n for r in complete_grid(rows, {"a": [1, 2], "b": [1, 2]}, {"n": 0}).collect()}
    assert got == {(1, None): 4, (2, 2): 5, (1, 1): 0, (1, 2): 0, (2, 1): 0}


def test_matching_columns(spark):
    row = spark.createDataFrame([(2, 3, 4)], "estrato_hh_a int, other int, n int")
    renamed = rename_matching(row, "^estrato_", "")
    assert renamed.columns == ["hh_a", "other", "n"]
    assert scale_matching(renamed, "hh_", F.col("n")).first() == (8, 3, 4)
