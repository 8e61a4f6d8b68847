"""Object-centric process analytics and corpus preparation on Spark."""
