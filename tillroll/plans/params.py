"""Query parameters, re-pointed from the reference's data to the test tables.

Fixed values: they appear verbatim in the oracle SQL as well.
"""

HOME = "NATION_7"            # the home market (largest country), like the reference's UK
YEAR = 2000                  # the reporting year
MONTH_NEW = "2001-07"        # last complete month  (reference: 2011-11)
MONTH_OLD = "2001-06"        # the month before it  (reference: 2011-10)
MONTH_PRIOR = "2001-05"      # two months back      (reference: 2011-09)
MONTH_PARTIAL = "2001-08"    # latest, partial month (reference: 2011-12)
MONTH_A = "2000-03"          # trading-day comparison pair (reference: 2011-03 / 2011-04)
MONTH_B = "2000-04"
COUNTRY_A = "NATION_11"      # two foreign markets compared (reference: Germany / France)
COUNTRY_B = "NATION_12"
CUSTOMER = 1378              # one customer (reference: 18102)
STOCK_CODE = "P558"          # one product code (reference: 22423)
TOP_N = 5
TOP_MARKETS = 6              # dashboard market chart size
MIN_ORDERS = 20              # minimum orders before ranking average order value
EXTREME_QTY = 48             # |quantity| above this is an extreme line
RANGE_FROM, RANGE_TO = "1999-01", "1999-12"   # month range trend
PAIR_WINDOW_DAYS = 30        # order and its cancellation at most this far apart
RESULT_CAP = 50              # bounded_result fetch cap
