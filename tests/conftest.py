import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# One feature of a tumour study: subject, treatment, value, covariate.
TUMOR = """
M16,EX_AL,-2.46251854710171,0.245
M18,EX_AL,-0.763465421542464,0.605
M19,EX_AL,1.41950845202929,0.481
M20,EX_AL,-0.144452379867632,0.506
M21,EX_ER,-0.677878095109766,0.447
M22,EX_ER,-0.311499016734596,0.285
M23,EX_ER,-3.88741386661789,0.083
M24,EX_ER,-0.868707710449164,0.463
M26,EX_ER,-2.72746150422362,0.171
M1,SED_AL,3.50081339016966,0.513
M2,SED_AL,0.810218835050811,0.331
M3,SED_AL,0.711525008764076,0.58
M4,SED_AL,0.304975449596627,0.707
M5,SED_AL,0.909738810224778,0.408
M6,SED_AL,1.86558368067758,0.199
M10,SED_ER,-0.939230507798028,0.558
M11,SED_ER,0.120752718059431,0.266
M12,SED_ER,-1.08118312548508,0.298
M13,SED_ER,-1.1945686654591,0.124
M7,SED_ER,-0.230093367422792,0.159
M8,SED_ER,-0.868707710449164,0.233
"""


@pytest.fixture(scope="session")
def tumor(spark):
    rows = [line.split(",") for line in TUMOR.strip().splitlines()]
    rows = [("q", s, t, *t.split("_"), float(v), float(c)) for s, t, v, c in rows]
    return spark.createDataFrame(
        rows, "feature string, subject string, treatment string, a string, b string, value double, cm3 double"
    ).cache()
