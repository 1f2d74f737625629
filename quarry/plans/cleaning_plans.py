"""Example cleaning plan exercising every action kind (used by the registered queries)."""

APPLY_PLAN = {
    "types": {"cust_txt": {"action": "convert_numeric"}, "date_txt": {"action": "convert_datetime"}},
    "missing": {"amount": {"action": "fill_median"}, "priority": {"action": "fill_constant", "constant": "MISSING"},
                "mostly_null": {"action": "drop_column"}, "cust_txt": {"action": "drop_rows"},
                "const_one": {"action": "fill_mean"}},
    "duplicates": {"action": "drop_duplicates"},
    "outliers": {"amount": {"action": "drop_rows"}, "o_orderkey": {"action": "winsorize"}},
}
