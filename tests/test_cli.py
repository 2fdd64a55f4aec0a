import pytest

from paperloom.__main__ import main
from tests.test_extraction import PAPER


def test_modes(spark, tmp_path):
    (tmp_path / "p.txt").write_text(PAPER)
    main(["-m", "extract_all", "-e", "ris-bib", str(tmp_path / "p.txt"), str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out/citations")).filter("valid").count() == 4
    assert spark.read.parquet(str(tmp_path / "out/bib")).count() == spark.read.parquet(str(tmp_path / "out/ris")).count() == 4
    for part in ("header", "sections", "contexts"):
        assert spark.read.parquet(str(tmp_path / "out" / part)).count()
    (tmp_path / "r.txt").write_text('A. Berg, "Fast parsing of records," Data Review, vol. 3, pp. 10-19, 1999.\n\n')
    main(["-i", "refs", str(tmp_path / "r.txt"), str(tmp_path / "refs")])
    assert [r.date for r in spark.read.parquet(str(tmp_path / "refs/citations")).collect()] == ["1999"]
    with pytest.raises(SystemExit):
        main(["-m", "extract_header", "-e", "bib", "x", "y"])
