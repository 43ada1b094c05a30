"""Walk-forward evaluation of factors: windows, screens, labels, models, portfolios and their accounting.

Tables are long: factors (date, stock, factor, value), returns (date, stock, ret), weights (date, stock, w).  ``date`` is a
DATE; trading dates are numbered where a calendar position is needed.
"""
