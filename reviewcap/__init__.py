"""reviewcap: review-capacity analytics for merchant risk rules, on Spark DataFrames."""
