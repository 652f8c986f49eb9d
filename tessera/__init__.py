"""Tessera: analytics over subject-relation-object facts, and a Datalog rule engine, as Spark DataFrames."""
