"""Digital-forensics analytics as DataFrame-in, DataFrame-out Spark operators.

Every public function takes DataFrames covering *all* cases and returns a lazy
DataFrame; nothing loops over cases on the driver.
"""

__version__ = "0.1.0"
