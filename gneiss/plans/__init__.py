"""gneiss.plans"""
