"""Where a crawl begins that is given no seeds."""

from __future__ import annotations

#: Widely used packages of the registry, in the order in which a crawl queues them.
SEEDS = tuple("""
express koa fastify @nestjs/core axios node-fetch got superagent
react react-dom vue svelte next @angular/core redux @reduxjs/toolkit react-router
webpack vite rollup esbuild parcel @babel/core typescript ts-node tsup
jest mocha vitest cypress playwright @testing-library/react sinon chai supertest
eslint prettier @typescript-eslint/parser stylelint husky lint-staged
mongoose sequelize prisma typeorm knex pg mysql2 redis ioredis
lodash underscore ramda moment dayjs date-fns uuid nanoid chalk commander yargs debug dotenv semver glob rimraf cross-env minimist
zod joi yup ajv class-validator
jsonwebtoken bcrypt passport helmet cors
winston pino morgan @sentry/node prom-client socket.io graphql apollo-server bull node-cron
nodemon concurrently npm-run-all sharp puppeteer
""".split())
