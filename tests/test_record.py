"""The record of a packet, on rows whose order is left open by day and position."""

import datetime as dt

from docketlab.operators import record

INSTRUMENT = "packet long, instrument long, pos long, kind string, number string, book_page string, documented string, recorded string, amount string, status string, address string, legal string, parties array<struct<name:string,role:string>>, refs array<string>, quotes string, evidence array<string>, verified boolean"
ENTRY = "packet long, entry long, ord long, number string, book_page string, kind string, documented string, recorded string, amount string, parties string, legal string, evidence array<string>, category string, verified boolean"
PACKET = "packet long, order_type string, order_type_state string, asked_type string, detected boolean, page_start int, page_end int, labelled boolean"


def deed(instrument, grantee, grantor):
    parties = [{"name": n, "role": r} for n, r in ((grantee, "Grantee"), (grantor, "Grantor")) if n]
    return (1, instrument, 5, "Warranty Deed", None, None, None, str(dt.date(2001, 2, 3)), None, None, None, None, parties, [], "text", ["e"], True)


def test_deeds_of_one_day_and_position_follow_by_instrument(spark):
    packets = spark.createDataFrame([(1, None, None, None, False, None, None, False)], PACKET)
    facts = spark.createDataFrame([], "packet long, name string, value string, state string, pages array<int>")
    entries = spark.createDataFrame([], ENTRY)
    references = spark.createDataFrame([], "packet long, reference long, number string, book_page string, kind string, description string")
    # 10 before 20: the grantee of 10 is the grantor of 20; the other way round the chain is broken
    rows = [deed(10, "Ann", "Zed"), deed(20, "Jo", "Ann")]
    for given in (rows, rows[::-1]):
        instruments = spark.createDataFrame(given, INSTRUMENT).coalesce(1)
        assert record.wide(packets, facts, instruments, entries, references).first().chain is True
