"""ledgerline: DataFrame operators over entity x year panels, written for Spark."""
