"""Cleaning, joining, modelling and evaluating load and weather series on Spark."""
