"""Training-data operators at corpus scale: each is a plan of Spark jobs over whole tables."""
