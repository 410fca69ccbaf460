"""A property-graph engine over source trees and relational tables, on Spark DataFrames."""
