"""Reports that SQL doesn't cover, against the reports that they are made of."""

from matchloom.plans import registry


def rows(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir).collect()


def test_figures_are_the_evaluation_turned(spark, sf_dir):
    by_mode = {r.mode: r for r in rows(spark, sf_dir, "q20_hybrid_evaluation")}
    got = {r.figure: r for r in rows(spark, sf_dir, "q28_hybrid_figures")}
    assert set(by_mode) == {"cv_only", "dl_only", "parallel", "cascade"} and len(got) == 6
    assert all(r[mode] == by_mode[mode][figure] for figure, r in got.items() for mode in by_mode)
    assert by_mode["cv_only"].escalation_percent == 0 and by_mode["cascade"].by_first + by_mode["cascade"].by_second == by_mode["cascade"].evaluated


def test_the_clean_loop_has_every_step(spark, sf_dir):
    got = rows(spark, sf_dir, "q26_clean_loop_report")
    of = lambda step: {r.name: r.value for r in got if r.step == step}
    assert of("evaluation") == {r.name: str(r.rank1) for r in rows(spark, sf_dir, "q1_classical_evaluation") if r.part == "sweep" and r.t == 0.2}
    assert sorted(of("tar_at_far").values()) == sorted(r.line for r in rows(spark, sf_dir, "q7_tar_far_report"))
    assert of("specification") == {r.family: r.verdict for r in rows(spark, sf_dir, "q9_spec_comparison")}
    assert len(of("accuracy_ratio")) == 12
