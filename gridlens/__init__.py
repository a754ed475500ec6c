"""Image-grid recognition, constraint analytics and hyper-parameter reporting on PySpark."""
