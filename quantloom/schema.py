"""Constants of the book and the calendars of stress windows."""

from __future__ import annotations

V0 = 1e6
ASSETS = ("px_a", "px_b", "px_c", "px_d")
UNDERLYING = "px_d"
WEIGHT = 0.25
IRS_NOTIONAL = 1e6
IRS_FIXED = 0.03
IRS_YEARS = 10
STRADDLE_DAYS = 30
STRADDLE_SHARES = 2000.0
TRADING_DAYS = 252
MIN_VOL = 1e-6
ALPHA = 0.99
Z_ALPHA = 2.3263478740408408
PHI_ALPHA = 0.02665214220345808
WINDOW = 500
MC_WINDOW = 750
COMPONENTS = ("linear", "irs", "straddle")
#: Stress windows (label, first day, last day) of the panel over `lineitem`; a parameter wherever they are used.
STRESS = (("W1", "1996-09-15", "1997-03-09"), ("W2", "1998-02-19", "1998-03-23"), ("W3", "2000-01-01", "2000-10-01"))
#: A book is a series of its own: every operator works book by book.
BOOK = "book"
