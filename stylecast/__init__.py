"""stylecast: retail demand analytics and production planning as Spark DataFrame operators."""
