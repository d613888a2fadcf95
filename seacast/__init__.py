"""seacast: crossing and sea-weather analytics as lazy PySpark DataFrame operators."""
