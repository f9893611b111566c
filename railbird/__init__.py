"""Racing-form analytics on Spark DataFrames.

A *race* is a small competing group, a *runner* one entrant of it, a runner's *form* its ordered
past runs, and a *price point* one timed quote for a runner.
"""
