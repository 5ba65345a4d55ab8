"""Talkloom: transcript analytics and training-data preparation on Spark."""
