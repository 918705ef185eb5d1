"""Settings from the environment, and schemas to text and back."""

import dataclasses
import pickle

import pytest
from pyspark.sql import types as T

from ledgerlake.plans import sdl
from ledgerlake.sources import paged
from ledgerlake.sources import settings as S
from ledgerlake.sources.schemas import ACCOUNT_BALANCE, CATEGORY, TABLES, TRANSACTION

ENVIRONMENT = {"APP_BANK__URL": "http://x", "app_bank__token": "t0p", "APP_STORE": "/s", "APP_BANK__RETRIES": "2", "APP_DELAY_SECONDS": "1.5", "APP_OTHER": "x", "STORE": "no"}


def test_nested_settings():
    got = S.from_environment(S.Settings, ENVIRONMENT)
    assert got == S.Settings(S.Bank("http://x", S.Secret("t0p"), 2), "/s", "Bank", 1.5)
    assert S.reader_options(got.bank) == {"url": "http://x", "token": "t0p", "retries": "2", "wait_seconds": "60.0"}


def test_secrets_are_never_shown():
    got = S.from_environment(S.Settings, ENVIRONMENT)
    shown = [repr(got), str(got), f"{got.bank.token}", f"{got.bank.token:>20}", "%s" % got.bank.token, str([got.bank.token]), str(dataclasses.asdict(got))]
    assert not any("t0p" in x for x in shown) and all("[redacted]" in x for x in shown)
    assert pickle.loads(pickle.dumps(got.bank.token)).expose() == "t0p" and got.bank.token != "t0p"
    with pytest.raises(S.MissingSettings) as e:
        S.from_environment(S.Settings, {"APP_BANK__URL": "u", "APP_BANK__RETRIES": "t0p", "APP_DELAY_SECONDS": "t0p"})
    assert "t0p" not in str(e.value) and all(x in str(e.value) for x in ("APP_BANK__TOKEN isn't set", "APP_STORE isn't set", "APP_BANK__RETRIES is no int", "APP_DELAY_SECONDS is no float"))


def test_plans_dont_show_options(spark):
    paged.register(spark)
    options = S.reader_options(S.Bank("http://127.0.0.1:1", S.Secret("t0p")))
    df = spark.read.format("paged_transactions").options(**options, accounts="").load().where("place > 1")
    assert "t0p" not in df._jdf.queryExecution().toString() + df._jdf.queryExecution().logical().treeString()
    regex = spark.sparkContext._jsc.sc().conf().get("spark.redaction.regex", "(?i)secret|password|token")
    assert spark._jvm.java.util.regex.Pattern.compile(regex).matcher("token").find()


def test_other_types_and_optional_parts():
    @dataclasses.dataclass
    class Part:
        n: int

    @dataclasses.dataclass
    class Whole:
        flag: bool
        part: S.Bank | None = None
        name: str | None = None

    assert S.from_environment(Whole, {"X_FLAG": "True"}, "x") == Whole(True)
    with pytest.raises(S.MissingSettings, match="X_FLAG is no bool"):
        S.from_environment(Whole, {"X_FLAG": "maybe"}, "x")
    with pytest.raises(S.MissingSettings, match="X_PART__TOKEN isn't set"):
        S.from_environment(Whole, {"X_FLAG": "0", "X_PART__URL": "u"}, "x")


REPORT = T.StructType([T.StructField(n, t, False) for n, t in (("month", T.StringType()), ("total_income", T.DoubleType()))])


def test_printed_text():
    got = sdl.printed(sdl.Schema({"Report": REPORT}, [sdl.Query("hello", "String", many=False), sdl.Query("reports", "Report", (("month", T.StringType()), ("year", T.StringType())))]))
    assert got == "type Report {\n  month: String!\n  total_income: Float!\n}\n\ntype Query {\n  hello: String!\n  reports(month: String!, year: String!): [Report!]!\n}\n"


def test_round_trip_of_all_schemas():
    odd = T.StructType.fromDDL("a array<array<struct<x: decimal(9,2), y: timestamp_ntz>>>, b struct<c: struct<d: binary not null> not null>, e smallint, f tinyint, g float, h timestamp, i bigint, j date, k boolean")
    types = {"Transaction": TRANSACTION, "AccountBalance": ACCOUNT_BALANCE, "Category": CATEGORY, "Odd": odd, **{n: T.StructType.fromDDL(c) for n, (c, _) in TABLES.items()}}
    queries = [sdl.Query("one", "Odd", (("n", T.LongType()), ("at", T.ArrayType(T.DateType(), False))), many=False), sdl.Query("all", "Category")]
    text = sdl.printed(sdl.Schema(types, queries))
    back = sdl.parsed(text)
    assert back.types == types and back.queries == queries and sdl.printed(back) == text
    assert "scalar Long\n" in text and "scalar String" not in text


def test_what_has_no_name_is_refused():
    with pytest.raises(ValueError):
        sdl.printed(sdl.Schema({"M": T.StructType.fromDDL("m map<string, int>")}))
    with pytest.raises(ValueError):
        sdl.parsed("type A {\n  x: Nothing\n}\n")
    with pytest.raises(ValueError):
        sdl.printed(sdl.Schema({"A": T.StructType.fromDDL("b struct<c: int>"), "A_b": T.StructType.fromDDL("c int")}))
