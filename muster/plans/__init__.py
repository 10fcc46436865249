"""Building blocks that keep a plan balanced when one key holds much of the data."""
