"""Operators on frames: tagged union, parameter grids, joins by position and time, series, shares, scaling."""
