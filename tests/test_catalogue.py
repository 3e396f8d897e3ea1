"""The catalogue is whole: every check has texts and fires somewhere."""
import duckdb

from check_queries import TABLES
from fleetaudit.operators.report import CATEGORIES
from fleetaudit.plans.catalogue import BASE, rules_for
from fleetaudit.queries.checks import _statements, all_of
from fleetaudit.queries.derived_fleet import SQL, with_tables
from fleetaudit.schemas import COLUMNS

IDS = {r.check_id for r in BASE}


def test_all_checks_are_there():
    # Check ids by category; 100 and 198, 199 belong to discovery.
    expected = ({100, *range(101, 121), 198, 199} | set(range(201, 219)) | set(range(301, 357)) | set(range(401, 433))
                | set(range(501, 507)) | set(range(601, 633)) | set(range(701, 743)))
    assert IDS == expected
    assert len(IDS) == 209


def test_rules_are_unique_and_filed():
    keys = [(r.check_id, r.case_no) for r in BASE]
    assert len(keys) == len(set(keys))
    assert {r.check_id // 100 for r in BASE} <= {c for c, _ in CATEGORIES}
    assert all(r.importance in (0, 1, 2, 3) for r in BASE)


def test_profiles_weigh_some_checks_differently():
    def of(profile, check_id, case_no=0):
        return next((r.importance, r.category) for r in rules_for(profile) if (r.check_id, r.case_no) == (check_id, case_no))

    assert of("health", 305) == (3, 2) and of("security", 305) == (2, None)
    assert of("backup", 210, 1) == (1, None) and of("security", 210, 1) == (2, None)
    assert of("health", 212) == (1, None) and of("security", 212) == (2, None)


def test_every_fleet_table_is_derived():
    assert set(SQL) == set(COLUMNS)


def test_every_check_fires_on_the_derived_fleet():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    fired = set()
    for statements in _statements().values():
        fired |= {tuple(r) for r in con.execute(with_tables(f"SELECT DISTINCT check_id, case_no FROM ({all_of(*statements)}) x")).fetchall()}
    assert {(r.check_id, r.case_no) for r in BASE} - fired == set()


def test_page_of_checks_is_current():
    from pathlib import Path

    from fleetaudit.plans.pages import checks_page

    assert (Path(__file__).resolve().parents[1] / "docs" / "checks.md").read_text() == checks_page()
