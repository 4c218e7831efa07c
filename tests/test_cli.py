import pytest

from sparsewright import cli
from sparsewright.sources import model


def _run(spark, *args):
    return cli.main([str(a) for a in args], spark)


def test_generate_train_predict_view(spark, tmp_path):
    assert dict(map(tuple, _run(spark, "generate", f"{tmp_path}/g", "--rows", 60, "--cols", 30, "--dim", 3).collect()))["type"] == "data"
    common = ("--dim", 4, "--reg", 0.01, "--epochs", 4, "--parts", 2, "--test", f"{tmp_path}/g/test")
    log = _run(spark, "train", f"{tmp_path}/g/train", f"{tmp_path}/m", *common, "--lrate", 0.02, "--biased", "--cptype", "SYNC", "--cpinterval", 2, "--cppath", f"{tmp_path}/cp").collect()
    assert [r["epoch"] for r in log] == [1, 2, 3, 4] and log[-1]["loss"] < log[0]["loss"] and log[-1]["test_rmse"] > 0
    (x,) = _run(spark, "predict", f"{tmp_path}/m", f"{tmp_path}/g/train", f"{tmp_path}/p").collect()
    assert x["rmse"] == pytest.approx(log[-1]["rmse"]) and x["n"] == model.load_data(spark, f"{tmp_path}/g/train").count()
    again = _run(spark, "train", f"{tmp_path}/g/train", f"{tmp_path}/m2", *common, "--lrate", 0.02, "--biased", "--cppath", f"{tmp_path}/cp", "--recover", 2).collect()
    assert [r["epoch"] for r in again] == [3, 4] and again[-1]["loss"] == pytest.approx(log[-1]["loss"])
    shown = dict(map(tuple, _run(spark, "view", f"{tmp_path}/m").collect()))
    assert (shown["type"], shown["dim"], shown["biased"]) == ("model", "4", "True")
    log = _run(spark, "train", f"{tmp_path}/g/train", f"{tmp_path}/c", "--solver", "ccd", "--dim", 2, "--reg", 0.1, "--epochs", 2).collect()
    assert log[-1]["loss"] < log[0]["loss"]


def test_convert(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("u1\ti2\t3\nu0\ti1\t1.5\nu1\ti2\t1\n")
    (tmp_path / "b.tsv").write_text("u2\ti0\t2\n")
    assert dict(map(tuple, _run(spark, "convert", tmp_path / "a.tsv", tmp_path / "b.tsv", f"{tmp_path}/o").collect()))["nnz"] == "2"
    assert sorted(map(tuple, model.load_data(spark, f"{tmp_path}/o/train").collect())) == [(0, 1, 1.5), (1, 2, 4.0)]
    assert sorted(map(tuple, model.load_data(spark, f"{tmp_path}/o/test").collect())) == [(2, 0, 2.0)]


@pytest.mark.parametrize("args", [("--cptype", "none at all"), ("--cptype", "sync"), ("--cptype", "vs", "--cpinterval", "2"), ("--recover", "1"), ("--dim", "0"), ("--solver", "ccd", "--biased")])
def test_options_that_do_not_fit_are_refused(args):
    with pytest.raises(ValueError):
        cli.checked(cli.parser().parse_args(["train", "in", "out", *args]))
