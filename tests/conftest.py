import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from resalekit.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(
            s.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="resalekit-test-"))
    yield s


D = dt.date

# Hand-made edge rows (see FIXTURES.md section 3); each row names its trap.
EVENT_ROWS = [
    (1, "2001-01-01", "£100,000", True),
    (1, "2001-01-01", "£120,000", False),   # keeps the higher price
    (1, "2003-01-01", "£150,000", None),
    (2, "2002-05-05", "£90,000", True),     # equal price: NULL flag wins
    (2, "2002-05-05", "£90,000", None),
    (2, "2002-05-10", "£95,000", False),
    (3, "2005-01-01", "£5,000", False),     # below floor
    (3, "2006-01-01", "£50,000", False),
    (3, "2007-01-01", "£60,000", False),
    (4, "2008-01-01", "POA", False),        # NULL price
    (4, "2009-01-01", "£80,000", False),
    (4, "2010-01-01", "£70,000", False),
    (5, None, "£10", True),                 # dropped: NULL date
    (6, "2010-01-01", "£10,000", False),    # one-day hold
    (6, "2010-01-02", "£100,000", False),
    (7, "2010-01-01", "£20,000", False),    # 364 days -> 1.00 years
    (7, "2010-12-31", "£21,000", False),
    (8, "2011-01-01", "£30,000", True),     # one sale only
    (99, "2012-01-01", "£40,000", True),    # orphan event
]

ENTITY_ROWS = [
    (1, "1 High St, London sw7 1rh", "Flat", None, 2, 1, "Leasehold", "£1,000", "2001-01-01", False),
    (2, "2 High St, London SW71RH", "Flat", None, 2, 1, "Freehold", "£1,000", "2001-01-01", False),
    (3, "3 Low St, M1 2AB", "Terraced", None, 3, 1, "Feudal", "£1,000", "2001-01-01", False),
    (4, "no postcode here", None, None, 1, 1, None, "POA", "2001-01-01", True),
    (5, "5 Low St, M1 5AB", "Detached", None, 4, 2, "Freehold", "£1,000", "2001-01-01", False),
    (6, "6 Low St, M1 3AB", "Detached", None, 4, 2, "Freehold", "£1,000", "2001-01-01", False),
    (7, "7 Low St, M1 3AB", "  ", None, 4, 2, "", "£1,000", "2001-01-01", False),
    (8, "8 Low St, EC1A 1BB", "Flat", None, 1, 1, "Freehold", "£1,000", "2001-01-01", False),
    (50, "50 Low St, M1 4AB", "Detached", None, 3, 2, "Freehold", "£1,000", "2001-01-01", False),
]

GEO_ROWS = [
    ("SW7", "SW", "South West London", "London", "England"),
    (" m1 ", "M", "Manchester", "North West", "England"),
]


@pytest.fixture(scope="session")
def raw_events(spark):
    return spark.createDataFrame(EVENT_ROWS, schemas.RAW_EVENTS)


@pytest.fixture(scope="session")
def raw_entities(spark):
    return spark.createDataFrame(ENTITY_ROWS, schemas.RAW_ENTITIES)


@pytest.fixture(scope="session")
def geo(spark):
    return spark.createDataFrame(GEO_ROWS, schemas.GEO_MAP)


@pytest.fixture(scope="session")
def enriched(raw_events, raw_entities, geo):
    from resalekit.operators.clean import clean_entities, clean_events
    from resalekit.operators.enrich import enrich
    return enrich(clean_events(raw_events, on_error="null"), clean_entities(raw_entities, on_error="null"),
                  geo, check_keys=True)
