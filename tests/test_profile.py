from helpers import YEAR
from schedulesmith.operators import profile as p

COLUMNS = {
    "years": ["1985", "1990", "2001", "1972"], "money": ["$1,500,000", "$250,000", "$875,000"],
    "states": ["NY", "CA", "TX", "N. Y."], "zips": ["10001", "90001", "60601", "10001.0", "10001-1234"],
    "sprinklers": ["Y", "N", "Y13", "Y", "N"], "blank": [None, "  ", ""], "negatives": ["-5", "(600)", "x"],
    "coordinates": ["40.1", "40.2"], "streets": ["10 Main", "Elm st", "Park"],
}


def test_profiles_and_fits(spark):
    rows = [(c, v) for c, vs in COLUMNS.items() for v in vs]
    prof = p.column_profiles(spark.createDataFrame(rows, "col string, value string"), ["col"], YEAR)
    by = {r.col: r for r in prof.collect()}
    assert by["blank"].empty and by["blank"].n == 0
    assert by["money"].currency_ratio == 1 and by["money"].mean == 875000
    assert by["negatives"].any_negative and by["negatives"].numeric_ratio == 2 / 3 and by["negatives"].min == -600
    assert by["zips"].zip_ratio == 1 and by["zips"].unique_ratio == 1
    assert by["sprinklers"].unique_ratio == 3 / 5 and by["sprinklers"].yn_ratio == 4 / 5
    assert by["states"].state_ratio == 1 and by["streets"].address_ratio == 2 / 3
    assert not by["coordinates"].all_integers and by["years"].all_integers

    fits = {(r.col, r.target): r for r in p.profile_fits(prof, ["col"], YEAR).collect()}
    assert len(fits) == 17 * len(COLUMNS)
    assert fits["years", "Year Built"].fit > 0.5
    assert fits["money", "Building Value"].fit > 0.3
    assert fits["states", "State"].fit > 0.7
    assert fits["zips", "Zip"].fit > 0.7
    assert fits["sprinklers", "Fire Sprinklers (Y/N)"].fit > 0.5
    assert fits["years", "Building Value"].fit <= 0.2 and fits["years", "Building Value"].contradicts
    assert fits["coordinates", "Reference"].fit == 0.2 and fits["coordinates", "City"].fit == 0
    blank = fits["blank", "State"]
    assert blank.fit == 0 and blank.map_fit == 0.5 and not blank.contradicts

    ops = {(r.col, r.target): r.operation for r in p.suggested_operations(prof, ["col"]).collect()}
    assert ops["money", "Contents"] == "strip_currency" and ops["coordinates", "BI"] == "to_float"
    assert ops["zips", "Zip"] == "to_zip" and ops["years", "Storeys"] == "to_int" and ops["years", "City"] == "trim_whitespace"
